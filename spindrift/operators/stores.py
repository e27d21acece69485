"""Node stores as tables: codes by state from a log, raw vectors by location, resident partitions, epochs in a shared folder.

Each function maps tables to tables; the tables may be of any size, as all work is by key.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.ranking import numbered
from spindrift.undecided import RawAbsent

OPS = ("put", "reserve", "ref", "unref", "release")


def code_states(log: DataFrame) -> DataFrame:
    """node, vec_id, refs, state of the codes that are held after a log of (node, vec_id, seq, op).

    put installs what is absent, protected; reserve protects what is held; ref counts a posting and ends protection; unref takes
    one away; release drops what was never referred to and ends the protection of the rest. A state is live with
    references, else staged while protected, else cached. Only the last position of each kind of entry matters, so a task combines
    its rows before the shuffle and no key's log is gathered. Entries of other kinds, or without an id, are left out."""
    last = lambda op: F.coalesce(F.max(F.when(F.col("op") == op, F.col("seq"))), F.lit(-1))
    refs = F.count_if(F.col("op") == "ref") - F.count_if(F.col("op") == "unref")
    g = log.where(F.col("op").isin(*OPS) & F.col("vec_id").isNotNull()).groupBy("node", "vec_id").agg(refs.alias("refs"), *[last(op).alias(op) for op in OPS])
    ever = F.col("ref") >= 0
    protected = F.when(ever, F.col("reserve") > F.greatest("ref", "release")).otherwise(F.lit(True))
    state = F.when(F.col("refs") > 0, "live").when(protected, "staged").otherwise("cached")
    return g.where(ever | (F.col("put") > F.col("release"))).select("node", "vec_id", "refs", state.alias("state"))


def code_stats(states: DataFrame) -> DataFrame:
    """node, resident, live, staged, cached: a row per node; resident is the sum of the others."""
    return states.groupBy("node").agg(F.count("*").alias("resident"), *[F.count_if(F.col("state") == s).alias(s) for s in ("live", "staged", "cached")])


def admitted(states: DataFrame, asked: DataFrame, capacity: DataFrame) -> DataFrame:
    """node, vec_id, change: what a batch of new codes does to stores of bounded capacity.

    states: node, vec_id, state, used (position of the last use). asked: node, vec_id, repeats and held codes included. capacity: node,
    slots. A node takes all of its new codes (`install`) if they fit after as many cached ones as are needed have gone (`evict`, least
    recently used first, then by id); else it changes nothing (`refuse`, a row per new code). Nodes without a capacity take nothing.

    Counts are aggregates per node; the order of victims is a global numbering by (node, use, id) less the node's first number, so
    that no node's codes meet in one task."""
    new = asked.select("node", "vec_id").distinct().join(states.select("node", "vec_id"), ["node", "vec_id"], "left_anti")
    held = states.groupBy("node").agg(F.count("*").alias("held"), F.count_if(F.col("state") == "cached").alias("cached"))
    want = new.groupBy("node").agg(F.count("*").alias("new")).join(held, "node", "left").join(capacity, "node", "left").fillna(0, ["held", "cached", "slots"])
    need = F.greatest(F.col("held") + F.col("new") - F.col("slots"), F.lit(0))
    want = want.select("node", need.alias("need"), (need <= F.col("cached")).alias("fits"))
    nth = numbered(states.where("state = 'cached'").select("node", "vec_id", "used"), [F.col("node"), F.col("used"), F.col("vec_id")], "nth")
    first = nth.groupBy("node").agg(F.min("nth").alias("first"))
    gone = nth.join(first, "node").join(want.where("fits"), "node").where(F.col("nth") - F.col("first") < F.col("need"))
    came = new.join(want, "node").select("node", "vec_id", F.when(F.col("fits"), "install").otherwise("refuse").alias("change"))
    return came.unionByName(gone.select("node", "vec_id", F.lit("evict").alias("change")))


def in_range(df: DataFrame, col: str, total: int | Column) -> DataFrame:
    """The same rows; one whose col isn't from 0 to total - 1 fails the job that reads it."""
    ok = (F.col(col) >= 0) & (F.col(col) < total)
    # the check hides in the column, so it isn't pruned as long as the column is read
    return df.withColumn(col, F.when(ok, F.col(col)).otherwise(F.raise_error(F.concat(F.lit(f"{col} out of range: "), F.coalesce(F.col(col).cast("string"), F.lit("null")))).cast(df.schema[col].dataType)))


def raw_missing(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """loc, once each, of what isn't present."""
    return wanted.select("loc").distinct().join(present.select("loc"), "loc", "left_anti")


def raw_put(present: DataFrame, batch: DataFrame, by: str = "seq") -> DataFrame:
    """loc, origin, data after a batch (loc, origin, data and the order `by`): the first write of a location stays."""
    first = batch.groupBy("loc").agg(F.min(F.struct(by, "origin", "data")).alias("x")).select("loc", "x.origin", "x.data")
    return present.select("loc", "origin", "data").unionByName(first.join(present.select("loc"), "loc", "left_anti"))


def raw_stats(present: DataFrame) -> DataFrame:
    """origin, n."""
    return present.groupBy("origin").agg(F.count("*").alias("n"))


def raw_get(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """wanted with data, repeated locations too. Fails at once if any is absent."""
    n = raw_missing(wanted, present).agg(F.count("*"), F.min("loc")).first()
    if n[0]:
        raise RawAbsent(f"{n[0]} raw vectors are not on this node (first: location {n[1]})")
    return wanted.join(present.select("loc", "data"), "loc")


def load(resident: DataFrame, parts: DataFrame) -> DataFrame:
    """resident (node, part) with more; a partition that is there already stays once."""
    return resident.select("node", "part").union(parts.select("node", "part")).distinct()


def evict(resident: DataFrame, parts: DataFrame) -> DataFrame:
    return resident.select("node", "part").join(parts.select("node", "part"), ["node", "part"], "left_anti")


class Conflict(ValueError):
    """Another writer was first."""


class EpochLog:
    """Tables by epoch in a folder that all writers share: one file an epoch, created only if it isn't there.

    Of several writers that made an epoch from the same one, one creates the file; the others get Conflict and, in commit(), go on from
    what is there. A local folder's file is made by a hard link, which refuses a name that is taken; elsewhere by a rename, which must
    refuse it too (HDFS does; object stores that replace what is there will not do). A new process goes on from the folder."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._hadoop = self._jvm.org.apache.hadoop
        self._folder = self._hadoop.fs.Path(path)
        self._fs = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._folder)

    def _file(self, epoch: int):
        return self._hadoop.fs.Path(self._folder, f"epoch-{epoch:012d}.json")

    def epochs(self) -> list[int]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._folder)]
        return sorted(int(n[6:-5]) for n in names if n.startswith("epoch-") and n.endswith(".json"))

    def table(self, epoch: int) -> dict:
        stream = self._fs.open(self._file(epoch))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def current(self) -> dict | None:
        all_of = self.epochs()
        return self.table(all_of[-1]) if all_of else None

    def history(self) -> list[dict]:
        return [self.table(e) for e in self.epochs()]

    def compare_and_swap(self, previous: int, table: dict) -> None:
        epoch, now = table["epoch"], (self.epochs() or [0])[-1]
        if previous != now:
            raise Conflict(f"epoch {epoch} was made from {previous}, not from {now}")
        if epoch != previous + 1 or not table.get("owners"):
            raise ValueError(f"epoch {epoch} doesn't follow {now}")
        # written in full under another name first: a reader never sees half a file
        part = self._hadoop.fs.Path(self._folder, f".{epoch}-{uuid.uuid4().hex}")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(table), "utf-8"))
        out.close()
        try:
            if not self._put(part, self._file(epoch)):
                raise Conflict(f"epoch {epoch} was installed by another writer")
        finally:
            self._fs.delete(part, False)

    def _put(self, part, name) -> bool:
        """Gives the file its name, unless the name is taken."""
        if self._fs.getScheme() != "file":
            return not self._fs.exists(name) and self._fs.rename(part, name)
        at = lambda p: self._jvm.java.io.File(self._fs.makeQualified(p).toUri().getPath()).toPath()
        try:
            self._jvm.java.nio.file.Files.createLink(at(name), at(part))
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        return True

    def commit(self, make: Callable[[dict | None], dict], tries: int = 100) -> dict:
        """Installs make(current table) with the next epoch's number; a writer that was not first makes its table again from the new one."""
        for _ in range(tries):
            now = self.current()
            previous = now["epoch"] if now else 0
            table = {**make(now), "epoch": previous + 1}
            with contextlib.suppress(Conflict):
                self.compare_and_swap(previous, table)
                return table
        raise Conflict(f"{tries} other writers were first")
