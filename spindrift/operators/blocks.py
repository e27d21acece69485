"""Nearest neighbours between two tables of integer vectors, in blocks.

Rows are packed into blocks by hash; each query block meets each row block through an equi-join on both blocks' numbers, so
the number of tasks grows with the rows however few the queries are. A pair of blocks is one matrix product (exact:
integers below 2^53) and leaves k rows per query, so what is shuffled afterwards is k rows per query and row
block. Blocks bound a task's memory, and a task holds a slice of their product at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.shipping import ship

#: Rows and queries of blocks whose pairs are all asked for.
PAIRED = 1024, 512
#: Rows of a row block and of a query block; query blocks that share a task, so that a row block is copied less often.
ROWS, QUERIES, GROUP = 8192, 1024, 4
#: Distances that a task holds at a time: a block's queries meet the rows in slices of so many, whatever the blocks' sizes.
HELD = 1 << 18


def _pack(df: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """df (cell, id, v): a row per block of about `size` rows of a cell (cell, b, ids, data), and (cell, n blocks)."""
    many = df.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(float(size))).cast("int").alias("__n"))
    df = df.join(many, "cell").withColumn("__b", F.pmod(F.xxhash64("id"), F.col("__n")).cast("int")).select("cell", "__b", "id", "v")

    def pack(key, t):
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t["v"].chunks]).astype("<f8")
        ids = t["id"].to_numpy().astype("<i8")
        cols = zip((key[0].as_py(), key[1].as_py(), ids.tobytes(), flat.tobytes()), ("int32", "int32", "binary", "binary"))
        return pa.table([pa.array([c], k) for c, k in cols], names=["cell", "b", "ids", "data"])

    return df.groupBy("cell", "__b").applyInArrow(pack, "cell int, b int, ids binary, data binary"), many


def _unpacked(t: pa.Table, order: bool = False) -> tuple[np.ndarray, np.ndarray]:
    ids, data = (b"".join(t[c].to_pylist()) for c in ("ids", "data"))
    ids = np.frombuffer(ids, "<i8")
    x = np.frombuffer(data, "<f8").reshape(len(ids), -1)
    at = np.argsort(ids, kind="stable") if order else slice(None)
    return ids[at], x[at]


def nearest_in_cells(queries: DataFrame, rows: DataFrame, k: int, row_block: int = ROWS, query_block: int = QUERIES, within: float | None = None) -> DataFrame:
    """queries, rows: (cell int, id, v array<bigint> of one length); a query meets the rows of its cells (it may have several,
    a row has one). qid, id, dist, rank (from 1): the k rows of least (dist, id) per query.

    within: rows farther than this many times the query's nearest are not asked for. Those farther than that from the nearest
    of their own block are left there; the caller cuts the rest."""
    ship(rows.sparkSession)
    return _best(*_pack(queries, query_block), *_pack(rows, row_block), k, within=within)


def _best(q: DataFrame, nq: DataFrame, r: DataFrame, nr: DataFrame, k: int, cost: bool = False, within: float | None = None) -> DataFrame:
    """cost: the last component of a row is no coordinate but is added to its distances."""
    groups = nq.select("cell", F.expr(f"cast((__n - 1) div {GROUP} as int)").alias("__g"))
    r = r.join(groups, "cell").withColumn("g", F.explode(F.sequence(F.lit(0), "__g"))).select("cell", "b", "g", "ids", "data")
    q = q.withColumn("g", F.expr(f"cast(b div {GROUP} as int)")).drop("b").join(nr, "cell").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).select("cell", "b", "g", "ids", "data")

    def meet(left, right):
        return _meet(left, right, k, cost, within)

    found = r.groupBy("cell", "b", "g").cogroup(q.groupBy("cell", "b", "g")).applyInArrow(meet, "qid bigint, id bigint, dist bigint")
    w = Window.partitionBy("qid").orderBy("dist", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _meet(left: pa.Table, right: pa.Table, k: int, cost: bool, within: float | None) -> pa.Table:
    """What a block of rows (left) is to blocks of queries, slice by slice of HELD distances."""
    if not left.num_rows or not right.num_rows:
        return pa.table([pa.array([], "int64")] * 3, names=["qid", "id", "dist"])
    b, y = _unpacked(left, True)
    more, z = (y[:, -1], np.ascontiguousarray(y[:, :-1])) if cost else (0.0, y)
    size = ((z * z).sum(axis=1) + more)[None, :]
    step = max(1, HELD // len(b))
    out = []
    for n in range(right.num_rows):
        ids, vectors = _unpacked(right.slice(n, 1))
        for i in range(0, len(ids), step):
            a, x = ids[i : i + step], vectors[i : i + step]
            d = x @ z.T
            d *= -2
            d += (x * x).sum(axis=1)[:, None] + size
            if within is not None:
                q, j = _near(d, k, within)
                out.append((a[q], b[j], np.rint(d[q, j]).astype("int64")))
                continue
            best = _first(d, k)
            got = np.take_along_axis(d, best, axis=1)
            out.append((np.repeat(a, best.shape[1]), b[best].ravel(), np.rint(got).astype("int64").ravel()))
    cols = [np.concatenate(c) for c in zip(*out)]
    return pa.table([pa.array(c, "int64") for c in cols], names=["qid", "id", "dist"])


def _first(d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least of each row, ties by place: all that are under the k-th and the first of those equal to it."""
    if k >= d.shape[1]:
        return np.argsort(d, axis=1, kind="stable")
    kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    rank = np.where(d < kth, 0, np.where(d == kth, 1, 2)).astype("int8")
    near = np.argsort(rank, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable"), axis=1)


def _near(d: np.ndarray, k: int, within: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of what _first() finds, but for places of more than `within` times their row's least. A bound that rounding
    may have lowered is raised by more than that."""
    hit = d <= (d.min(axis=1) * within * (1 + 1e-9) + 1)[:, None]
    many = np.flatnonzero(np.count_nonzero(hit, axis=1) > k)
    if len(many):
        hit[many] = False
        hit[many[:, None], _first(d[many], k)] = True
    return np.nonzero(hit)


def nearest(queries: DataFrame, rows: DataFrame, k: int, row_block: int = ROWS, query_block: int = QUERIES, within: float | None = None) -> DataFrame:
    """queries, rows: (id, v). Every query meets all rows, block by block."""
    cell = F.lit(0).alias("cell")
    return nearest_in_cells(queries.select(cell, "id", "v"), rows.select(cell, "id", "v"), k, row_block, query_block, within)


def nearest_at_cost(queries: DataFrame, rows: DataFrame, k: int, row_block: int = ROWS, query_block: int = QUERIES) -> DataFrame:
    """As nearest(), for rows (id, v, cost): the k rows of least (dist + cost, id). Pairs that lose leave no row."""
    ship(rows.sparkSession)
    cell = F.lit(0).alias("cell")
    r = rows.select(cell, "id", F.concat("v", F.array(F.col("cost").cast("long"))).alias("v"))
    return _best(*_pack(queries.select(cell, "id", "v"), query_block), *_pack(r, row_block), k, cost=True)


def all_pairs(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """queries, rows: (id, v array<double> of one length). qid, id, dist of every pair: squares summed from the left, null if a vector or a
    component is. Blocks meet as in nearest(); the pairs of two blocks are what a task holds."""
    ship(rows.sparkSession)
    nr, nq = (max(1, -(-df.count() // size)) for df, size in zip((rows, queries), PAIRED))
    of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    r = rows.select(of(nr).alias("b"), every(nq).alias("g"), "id", "v")
    q = queries.select(every(nr).alias("b"), of(nq).alias("g"), "id", "v")

    def meet(left, right):
        (b, y, there), (a, x, asked) = _plain(left), _plain(right)
        d = np.zeros((len(a), len(b)))
        if len(a) and len(b) and x.shape == (len(a), y.shape[1]):
            cols = np.ascontiguousarray(y.T)
            for i in range(0, len(a), 32):
                for c, z in enumerate(cols):
                    diff = x[i : i + 32, c, None] - z
                    d[i : i + 32] += diff * diff
        else:
            asked = np.zeros(len(a), bool)
        known = (asked[:, None] & there).ravel()
        return pa.table([pa.array(np.repeat(a, len(b))), pa.array(np.tile(b, len(a))), pa.array(d.ravel(), mask=~known)], names=["qid", "id", "dist"])

    return r.groupBy("b", "g").cogroup(q.groupBy("b", "g")).applyInArrow(meet, "qid bigint, id bigint, dist double")


def _plain(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, vectors and which are there in full; the others are zeros."""
    v = t["v"].combine_chunks()
    size = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat, wide = v.flatten(), int(size.max(initial=0))
    holes = np.add.reduceat(np.append(flat.is_null().to_numpy(zero_copy_only=False), False).astype(int), np.minimum(np.cumsum(size) - size, len(flat))) if len(size) else size
    full = (size == wide) & v.is_valid().to_numpy(zero_copy_only=False) & ~((size > 0) & (holes > 0))
    x = np.zeros((len(size), wide))
    x[full] = flat.to_numpy(zero_copy_only=False)[np.repeat(full, size)].reshape(-1, wide) if wide else 0
    return t["id"].to_numpy(), x, full
