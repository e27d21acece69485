"""Exact top-k inner products by aggregation of sorted lists without random access.

Each block of rows keeps one list per dimension, sorted by value. A query opens the lists in the order of what they can
change (its weight times the list's spread) and reads each one sequentially, from its top where the weight is positive and
from its bottom where it is negative. Of every row it keeps the sum of the contributions read and the sum of the squares read; a list's entry also carries the row's squared norm, as it is known when a row is first seen. Lower and upper
bounds follow: what is unread of an opened list is no better than the last value read, and what is unread at
all is held between plus and minus the product of the two remaining norms (Cauchy-Schwarz), and no better than the far
ends of the lists. The reading goes on in rounds, more lists and deeper, until the rows that can reach the k-th best lower
bound are few (at most an eighth of the block); all others, seen or not, cannot qualify, and the few get their final scores.

Query blocks meet row blocks through an equi-join on both blocks' numbers; a block's k best rows per query then meet in
one ranking with partial limits. A task holds one block of rows and a few blocks of queries.

How far it reads depends on the data: random directions in 64 dimensions are near the worst case (see README).

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do null ids;
rows that share a vec_id are separate rows, each a candidate of the others, and repeated rows too; vectors of other lengths
than the query's are no candidates; ties go to the smaller vec_id; scores past a long are held at its ends; components
whose products pass 2^53 are summed as Python integers, with the same result; empty tables give no rows. Only vec_id and
embedding are read, so extra columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

#: Rows of a block (fewer for long vectors: COMPONENTS at most), queries of a block, query blocks of a task.
ROW_BLOCK, COMPONENTS, QUERY_BLOCK, GROUP = 65536, 1 << 22, 64, 4
#: Rounds: the share of the lists that are open, and the share of each that is read by the round's end.
ROUNDS = ((0.125, 0.25), (0.25, 0.5), (0.5, 1.0), (0.5625, 1.0), (0.625, 1.0), (0.6875, 1.0), (0.75, 1.0), (0.875, 1.0), (1.0, 1.0))


def quantised(df: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, tag, v: floor(scale * x) of every component, as doubles (integers by value); usable vectors only. vec_id
    and tag (a hash of the vector and the number among equal rows) tell rows apart."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(x, lambda c: F.rint(F.floor(F.lit(float(scale)) * c.cast("double")).cast("double")))
    good = df.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(~bad)
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).withColumn("h", F.xxhash64("v"))
    copy = F.row_number().over(Window.partitionBy("vec_id", "h").orderBy("v"))
    return good.withColumn("copy", copy).select("vec_id", F.xxhash64("h", "copy").alias("tag"), "v")


class Lists:
    """The sorted lists of one block of rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, tags: np.ndarray | None = None):
        tags = np.zeros(len(ids), "int64") if tags is None else tags
        at = np.lexsort((tags, ids))
        self.ids, self.tags, self.rows = ids[at], tags[at], rows[at].astype("float64")
        self.most = float(np.abs(self.rows).max(initial=0))
        self.norms = (self.rows**2).sum(axis=1)
        self.order = np.argsort(self.rows, axis=0, kind="stable").T.copy()  # of each list, ascending
        self.values = np.take_along_axis(self.rows.T, self.order, axis=1)
        self.squares = self.values**2
        self.place = {}

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, own_tags: np.ndarray | None = None) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, float]]:
        """(query's place, ids, tags, scores, share of the lists' entries read); own, own_tags: the row that is no candidate."""
        own_tags = np.zeros(len(own), "int64") if own_tags is None else own_tags
        most = max(self.most, float(np.abs(queries).max(initial=0))) ** 2 * self.rows.shape[1]
        if most >= 2**53:
            return self._exact(queries, own, own_tags, k)
        out = []
        for j, q in enumerate(queries):
            a, b = np.searchsorted(self.ids, own[j]), np.searchsorted(self.ids, own[j], "right")
            mine = a + np.flatnonzero(self.tags[a:b] == own_tags[j])
            out.append((j, *self._one(np.asarray(q, "float64"), mine, k)))
        return out

    def _one(self, q, mine, k):
        dims, n = self.values.shape
        far = np.where(q >= 0, self.values[:, -1], self.values[:, 0])  # best ends
        lists = np.argsort(-np.abs(q) * (self.values[:, -1] - self.values[:, 0]), kind="stable")
        known, squares, count = np.zeros(n), np.zeros(n), np.zeros(n, "int64")
        before, read = (0, 0), 0  # lists that are open, entries read of each
        for opened, share in ROUNDS:
            now, to = lists[: int(np.ceil(opened * dims))], n if share == 1.0 else int(np.ceil(share * n))
            old, new = now[: before[0]], now[before[0] :]
            for i, x in [*((i, before[1]) for i in old.tolist()), *((i, 0) for i in new.tolist())]:
                if x >= to:
                    continue
                part = slice(n - to, n - x) if q[i] >= 0 else slice(x, to)
                rows = self.order[i, part]
                known += np.bincount(rows, self.values[i, part] * q[i], n)
                squares += np.bincount(rows, self.squares[i, part], n)
                if to < n:
                    count += np.bincount(rows, minlength=n)
                read += to - x
            before = len(now), to
            closed = np.ones(dims, bool)
            closed[now] = False
            rest = np.sqrt(np.maximum(self.norms - squares, 0)) * (1 + 1e-6)
            away = np.sqrt((q[closed] ** 2).sum()) * rest
            if to < n:  # rows that an opened list has not shown are no better than its last value
                last = np.where(q[now] >= 0, self.values[now, n - to], self.values[now, to - 1])
                upper = known + np.maximum(q[now] * last, 0).sum() + np.minimum(away, np.maximum(q[closed] * far[closed], 0).sum())
                lower = np.where(count == len(now), known - away, known - np.sqrt((q**2).sum()) * rest)
            else:
                upper = known + np.minimum(away, (q[closed] * far[closed]).sum())
                lower = known - away
            lower[mine] = upper[mine] = -np.inf
            kk = min(k, n)
            kth = np.partition(lower, n - kk)[n - kk] - 1e-3
            able = np.flatnonzero((upper >= kth) & (upper > -np.inf))  # a tie at the bound may still win by its id
            if len(able) <= max(4 * k, n // 8) or read == n * dims:
                break
        final = self.rows[able] @ q
        best = np.lexsort((self.tags[able], self.ids[able], -final))[:k]
        return self.ids[able[best]], self.tags[able[best]], np.rint(final[best]).astype("int64"), read / (n * dims)

    def _exact(self, queries, own, own_tags, k):
        """Numbers too large for doubles: whole lists, in Python's integers."""
        whole = [[int(x) for x in r] for r in self.rows]
        out = []
        for j, q in enumerate(queries):
            w = [int(x) for x in q]
            score = sorted((-sum(a * b for a, b in zip(w, r)), int(i), int(t)) for r, i, t in zip(whole, self.ids, self.tags) if (i, t) != (own[j], own_tags[j]))[:k]
            clip = [min(max(-s, -(2**63)), 2**63 - 1) for s, *_ in score]
            out.append((j, np.array([i for _, i, _ in score], "int64"), np.array([t for *_, t in score], "int64"), np.array(clip, "int64"), 1.0))
        return out


_BLOCK = "dims int, b int, ids binary, tags binary, data binary"


def _blocks(df: DataFrame, per_block: int) -> DataFrame:
    """Rows packed by dimension and hash into blocks of about per_block: dims, b, ids, tags, data."""
    df = df.withColumn("dims", F.size("v"))
    per = F.greatest(F.lit(1.0), F.least(F.lit(float(per_block)), F.lit(float(COMPONENTS)) / F.col("dims")))
    many = df.groupBy("dims").agg(F.count("*").alias("__n")).withColumn("__n", F.ceil(F.col("__n") / per))
    df = df.join(many, "dims").withColumn("b", F.pmod(F.xxhash64("vec_id", "tag"), F.col("__n")).cast("int")).select("dims", "b", "vec_id", "tag", "v")

    def pack(key, t):
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t["v"].chunks]).astype("<f8")
        if np.abs(flat).max(initial=0) < 2**31:
            flat = flat.astype("<i4")
        cols = [key[0].as_py(), key[1].as_py(), t["vec_id"].to_numpy().astype("<i8").tobytes(), t["tag"].to_numpy().astype("<i8").tobytes(), flat.tobytes()]
        return pa.table([pa.array([c], k) for c, k in zip(cols, ("int32", "int32", "binary", "binary", "binary"))], names=["dims", "b", "ids", "tags", "data"])

    return df.groupBy("dims", "b").applyInArrow(pack, _BLOCK)


def _unpacked(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, tags = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["tags"], "<i8")
    kind = "<i4" if len(r["data"]) == 4 * len(ids) * r["dims"] else "<f8"
    return ids, tags, np.frombuffer(r["data"], kind).reshape(len(ids), r["dims"]).astype("float64")


def search(queries: DataFrame, rows: DataFrame, k: int = 5, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK, group: int = GROUP) -> DataFrame:
    """queries, rows: (vec_id, tag, v) of quantised(). Returns query_id, query_tag, rank, vec_id, score, share_read (of the
    entries of the lists of the row's block)."""
    small_batches(rows.sparkSession)
    q = _blocks(queries, query_block).withColumn("g", F.expr(f"cast(b div {group} as int)"))
    last = q.groupBy("dims").agg(F.max("g").alias("__last"))
    # every row block meets every group of query blocks of its length: a key of its own for each such pair
    r = _blocks(rows, row_block).join(last, "dims").withColumn("g", F.explode(F.sequence(F.lit(0), F.col("__last")))).drop("__last")
    q = q.withColumnRenamed("b", "qb")
    many = r.groupBy("dims").agg(F.max("b").alias("__last"))
    q = q.join(many, "dims").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("__last")))).select("dims", "b", "g", "ids", "tags", "data")
    names = ["query_id", "query_tag", "vec_id", "tag", "score", "share_read"]
    kinds = ("int64", "int64", "int64", "int64", "int64", "float64")

    def meet(left, right):
        cols = [[] for _ in names]
        for x in left.to_pylist():  # one block
            ids, tags, data = _unpacked(x)
            lists = Lists(ids, data, tags)
            for y in right.to_pylist():
                own, own_tags, asked = _unpacked(y)
                for j, i, t, score, share in lists.search(asked, own, k, own_tags):
                    for to, c in zip(cols, (np.full(len(i), own[j]), np.full(len(i), own_tags[j]), i, t, score, np.full(len(i), share))):
                        to.append(c)
        return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(cols, kinds)], names=names)

    best = r.groupBy("dims", "b", "g").cogroup(q.groupBy("dims", "b", "g")).applyInArrow(meet, "query_id bigint, query_tag bigint, vec_id bigint, tag bigint, score bigint, share_read double")
    w = Window.partitionBy("query_id", "query_tag").orderBy(F.desc("score"), "vec_id", "tag")
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "query_tag", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "share_read")


def query(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """Queries are the rows whose id is divisible by `every`, against all rows."""
    rows = quantised(embeddings)
    return search(rows.where(F.col("vec_id") % every == 0), rows, k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.rid, q.vec_id AS query_id, r.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e r ON q.rid <> r.rid AND len(q.v) = len(r.v) WHERE q.vec_id % 50 = 0),
k AS (SELECT query_id, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS n, vec_id, score FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM k WHERE n <= 5
"""
