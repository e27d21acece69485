"""Placement of partitions on nodes: initial tables, repartitioning, plans, ranges, history, node stores and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.undecided import Undecided

# --- tables of a few thousand rows, on the driver --------------------------------------------------------------


def initial(parts: int, nodes: list[int]) -> list[int]:
    """Owner of each partition: contiguous blocks, the first parts % len(nodes) nodes with one more."""
    if not nodes or parts < len(nodes) or len(set(nodes)) < len(nodes):
        raise ValueError("nodes must be different and at most as many as partitions")
    base, rem = divmod(parts, len(nodes))
    return [n for i, n in enumerate(nodes) for _ in range(base + (i < rem))]


def _goals(placement: DataFrame, nodes: list[int]) -> DataFrame:
    """seq, node, own, first, goal: counts differ by at most one, the extra partitions are with those that own most."""
    if not nodes or len(set(nodes)) < len(nodes):
        raise ValueError("nodes must be different and at most as many as partitions")
    spark = placement.sparkSession
    listed = spark.createDataFrame(list(enumerate(nodes)), "seq int, node int")
    own = placement.groupBy("node").agg(F.count("*").alias("own"), F.min("part").alias("first"))
    # nodes are few (a table on the driver names them), so one window over them is enough
    total = F.sum("own").over(Window.partitionBy())
    n = listed.join(own, "node", "full").fillna(0, ["own"])
    n = n.withColumn("total", total).where("seq is not null or own > 0")
    by_size = F.row_number().over(Window.partitionBy(F.col("seq").isNull()).orderBy(F.desc("own"), "seq"))
    base = F.expr(f"total div {len(nodes)}")
    goal = F.when(F.col("seq").isNull(), 0).otherwise(base + (by_size <= F.col("total") % len(nodes)).cast("int"))
    return n.withColumn("goal", goal)


def _slots(goals: DataFrame) -> DataFrame:
    """dst, lo, hi: which of the dealt partitions (numbered from 0) each node that needs some takes, in order of nodes."""
    need = goals.where("goal > own").withColumn("need", F.col("goal") - F.col("own"))
    return need.withColumn("hi", F.sum("need").over(Window.orderBy("seq"))).select(F.col("node").alias("dst"), (F.col("hi") - F.col("need")).alias("lo"), "hi")


def _taken(give: DataFrame, slots: DataFrame) -> DataFrame:
    """give (src, part, depth, first): partitions are dealt from the ends of their donors, one of each donor in turn."""
    give = give.withColumn("pick", F.row_number().over(Window.orderBy("depth", "first")) - 1)
    return give.join(F.broadcast(slots), (F.col("pick") >= F.col("lo")) & (F.col("pick") < F.col("hi"))).select("src", "dst", "part")


def scale_out(placement: DataFrame, nodes: list[int]) -> DataFrame:
    """src, dst, part for nodes that join. The order in which donors give is (depth from a donor's end, donor's first
    partition); joining nodes take runs of it."""
    n = _goals(placement, nodes)
    depth = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("part"))) - 1
    give = placement.join(n.where("own > 0").select("node", "own", "goal", "first"), "node").withColumnRenamed("node", "src")
    return _taken(give.withColumn("depth", depth).where("depth < own - goal"), _slots(n.where("own = 0")))


def scale_in(placement: DataFrame, nodes: list[int], ever: DataFrame | None = None) -> DataFrame:
    """src, dst, part for nodes that leave: all their partitions, dealt like scale_out()'s.

    ever: (part, node) that have been. Then each partition goes home first: to a node that has owned it, while that node
    has room (the lowest partitions of a home come first)."""
    n = _goals(placement, nodes)
    gone = placement.join(n.where("seq is null").select("node", "first"), "node").select(F.col("node").alias("src"), "part", "first")
    if ever is None:
        give, home, slots = gone, None, _slots(n.where("seq is not null"))
    else:
        room = n.where("seq is not null").select(F.col("node").alias("dst"), "seq", (F.col("goal") - F.col("own")).alias("room"))
        # a partition's home: of the nodes that had it, the first in the list; of a home's partitions, as many as have room
        could = gone.join(ever.select("part", F.col("node").alias("dst")).distinct(), "part").join(room.where("room > 0"), "dst")
        one = could.groupBy("part", "src", "first").agg(F.min(F.struct("seq", "dst", "room")).alias("h"))
        nth = F.row_number().over(Window.partitionBy("h.dst").orderBy("first", "part"))
        home = one.withColumn("nth", nth).where("nth <= h.room").select("src", F.col("h.dst").alias("dst"), "part")
        give = gone.join(home.select("part"), "part", "left_anti")
        came = home.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("came"))
        slots = _slots(n.where("seq is not null").join(came, "node", "left").withColumn("own", F.col("own") + F.coalesce("came", F.lit(0))))
    depth = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("part"))) - 1
    moves = _taken(give.withColumn("depth", depth), slots)
    return moves if home is None else home.unionByName(moves)


def repartition(spark: SparkSession, owners: list[int], nodes: list[int], ever: set[tuple[int, int]] | None = None) -> tuple[list[int], list[tuple[int, int, int]]]:
    """New owners and moves (source, destination, partition) for another set of nodes, by scale_out() or scale_in().

    ValueError for nodes that repeat, are more than the partitions, or join and leave in one step; Undecided where a node that
    stays would take from, or give to, another one that stays."""
    have = set(owners)
    joined, left = [n for n in nodes if n not in have], sorted(have - set(nodes))
    if not nodes or len(owners) < len(nodes) or len(set(nodes)) < len(nodes):
        raise ValueError("nodes must be different and at most as many as partitions")
    if joined and left:
        raise ValueError("nodes can't join and leave in one step")
    if not joined and not left:
        return list(owners), []
    placement = spark.createDataFrame(list(enumerate(owners)), "part int, node int")
    stay = _goals(placement, nodes).where("seq is not null and own > 0").where(F.col("goal") > F.col("own") if joined else F.col("goal") < F.col("own"))
    if stay.limit(1).count():
        raise Undecided("U3")
    if joined:
        moves = scale_out(placement, nodes)
    else:
        moves = scale_in(placement, nodes, spark.createDataFrame(sorted(ever), "part int, node int") if ever else None)
    moves = sorted(tuple(r) for r in moves.select("src", "dst", "part").collect())
    to = {p: n for _, n, p in moves}
    return [to.get(p, n) for p, n in enumerate(owners)], moves


def weighted(*_):
    raise Undecided("U3")


def round_robin(dsts: list[int], n: int, start: int) -> tuple[list[int], int]:
    """Source of each destination, and where the next call starts; -1 without sources."""
    return ([-1] * len(dsts), start) if not n else ([(start + i) % n for i in range(len(dsts))], (start + len(dsts)) % n)


def rescale_nodes(idle: list[int], active: list[int], target: int) -> tuple[list[int], list[int]]:
    """Who joins (lowest idle ids) and who leaves (highest active ids)."""
    d = target - len(active)
    if d > len(idle):
        raise ValueError(f"{d} nodes needed, {len(idle)} idle")
    return (sorted(idle)[:d], []) if d > 0 else ([], sorted(active)[len(active) + d :] if d else [])


def rescaled(nodes: DataFrame, target: int) -> DataFrame:
    """what, node: nodes (node, active) that join (lowest idle ids) or leave (highest active ids) for a target number."""
    d = target - nodes.where("active").count()
    if d > nodes.where("not active").count():
        raise ValueError(f"{d} nodes needed")
    rows = nodes.where("not active").orderBy("node").limit(d) if d > 0 else nodes.where("active").orderBy(F.desc("node")).limit(-d)
    return rows.select(F.lit("join" if d > 0 else "leave").alias("what"), "node")


class History:
    """Which node has held which partition, and where a copy is left."""

    def __init__(self, owners: list[int]):
        self.owned: set[tuple[int, int]] = set()
        self.copies: set[tuple[int, int]] = set()
        self.record(owners)

    def record(self, owners: list[int]) -> None:
        self.owned |= (now := set(enumerate(owners)))
        self.copies |= now

    def forget(self, part: int, node: int) -> None:
        self.copies.discard((part, node))

    def had_copy(self, part: int, node: int) -> bool:
        return (part, node) in self.copies

    def has_owned(self, part: int, node: int) -> bool:
        return (part, node) in self.owned


class TokenBucket:
    """Bytes per second in two classes: background gives way while data is being sent. Simulated time."""

    def __init__(self, rate: float, burst: float):
        self.rate, self.burst, self.level, self.at = rate, burst, burst, 0.0
        self.data_until = 0.0

    def send(self, now: float, size: float, background: bool = False) -> float:
        """When a transfer that asks at `now` may go."""
        start = max(now, self.at, self.data_until if background else 0.0)
        self.level = min(self.burst, self.level + (start - self.at) * self.rate)
        wait = max(0.0, (size - self.level) / self.rate)
        self.level += wait * self.rate - size
        self.at = start + wait
        if not background:
            self.data_until = self.at
        return self.at


def fixed_rate(rate: float):
    return lambda _: rate


def adaptive_rate(*_):
    raise Undecided("U8")


class EpochStore:
    """Tables by epoch; a new one is installed only over the one it was made from."""

    def __init__(self):
        self.tables: list[dict] = []

    def current(self) -> dict | None:
        return self.tables[-1] if self.tables else None

    def compare_and_swap(self, previous: int, table: dict) -> None:
        now = self.tables[-1]["epoch"] if self.tables else 0
        if previous != now or table["epoch"] != previous + 1 or not table.get("owners"):
            raise ValueError(f"epoch {table['epoch']} doesn't follow {now}")
        self.tables.append(table)


# --- tables as DataFrames --------------------------------------------------------------------------------------


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """src, dst, part where the owner differs."""
    return old.select("part", F.col("node").alias("src")).join(new.select("part", F.col("node").alias("dst")), "part").where("src <> dst").select("src", "dst", "part")


def plan(moves: DataFrame) -> DataFrame:
    """dst, src, parts (ascending): what each destination pulls."""
    return moves.groupBy("dst", "src").agg(F.sort_array(F.collect_list("part")).alias("parts"))


def ranges(placement: DataFrame) -> DataFrame:
    """node, lo, hi: runs of consecutive partitions of one owner."""
    island = F.col("part") - F.row_number().over(Window.partitionBy("node").orderBy("part"))
    return placement.withColumn("island", island).groupBy("node", "island").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).select("node", "lo", "hi")


def from_ranges(runs: DataFrame) -> DataFrame:
    return runs.select("node", F.explode(F.sequence("lo", "hi")).alias("part"))


def apply_moves(placement: DataFrame, moves: DataFrame) -> DataFrame:
    return placement.join(moves.select("part", "dst"), "part", "left").select("part", F.coalesce("dst", "node").alias("node"))


def named(list_part: DataFrame, postings: DataFrame) -> DataFrame:
    """part, vec_id: what a partition's lists name, once each."""
    return postings.join(list_part, "list_id").select("part", "vec_id").distinct()


def held(placement: DataFrame, named_by: DataFrame) -> DataFrame:
    """node, vec_id held under a placement."""
    return named_by.join(F.broadcast(placement), "part").select("node", "vec_id").distinct()


def missing(moves: DataFrame, named_by: DataFrame, held_now: DataFrame) -> DataFrame:
    """dst, src, vec_id: what a destination's new partitions name and it doesn't hold, once, from the first source."""
    want = named_by.join(F.broadcast(moves), "part").groupBy("dst", "vec_id").agg(F.min("src").alias("src"))
    return want.join(held_now.withColumnRenamed("node", "dst"), ["dst", "vec_id"], "left_anti").select("dst", "src", "vec_id")


def references(placement: DataFrame, list_part: DataFrame, postings: DataFrame) -> DataFrame:
    """node, vec_id, refs: postings in resident partitions."""
    return postings.join(list_part, "list_id").join(F.broadcast(placement), "part").groupBy("node", "vec_id").agg(F.count("*").alias("refs"))


def segment_bytes(list_part: DataFrame, postings: DataFrame) -> DataFrame:
    """part, bytes: lists * 4 + (lists + 1) * 8 + postings * 8."""
    n = list_part.join(postings.groupBy("list_id").agg(F.count("*").alias("n")), "list_id", "left").groupBy("part")
    return n.agg((F.count("*") * 4 + (F.count("*") + 1) * 8 + F.coalesce(F.sum("n"), F.lit(0)) * 8).alias("bytes"))


PHASES = {"lazy": ["stage", "flip", "stream_raw", "drain", "reclaim"], "copy-then-flip": ["stage", "copy_raw", "flip", "drain", "reclaim"], "stop-and-copy": ["pause", "stage", "copy_raw", "flip", "resume", "reclaim"]}


def ledger(protocol: str, old: DataFrame, new: DataFrame, list_part: DataFrame, postings: DataFrame, code_bytes: int = 8) -> DataFrame:
    """One row: protocol, moved, pq_codes, raw_vectors, bytes of a rescale. Codes and vectors new to a node are counted once."""
    if protocol not in PHASES:
        raise ValueError(protocol)
    moves, by = diff(old, new), named(list_part, postings)
    lost = missing(moves, by, held(old, by))
    size = segment_bytes(list_part, postings).join(moves, "part")
    n = lost.agg(F.count("*").alias("pq_codes"))
    m = moves.agg(F.count("*").alias("moved"))
    b = size.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("segments"))
    return m.crossJoin(n).crossJoin(b).select(F.lit(protocol).alias("protocol"), "moved", "pq_codes", F.col("pq_codes").alias("raw_vectors"), (F.col("segments") + F.col("pq_codes") * code_bytes).alias("bytes"))
