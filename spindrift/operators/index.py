"""Index tables (vectors, heads, postings, codebook, codes, layout) and the search over them.

The registered recipe is deterministic: heads are the vectors whose id is divisible by 10 (a head ratio of a tenth), the
codebook's 256 codewords are the vectors of the 256 smallest ids, and queries are the ids divisible by 50. All other
tables follow by the rules below. Trained builds are in train.py.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions import vectors as V
from spindrift.operators import graph as proximity
from spindrift.operators.blocks import nearest, nearest_in_cells
from spindrift.operators.ranking import numbered, prefix_sums
from spindrift.shipping import ship
from spindrift.undecided import NotResident


@dataclass(frozen=True)
class Params:
    """Search and build parameters with the bounds that requests are checked against."""

    k: int = 10
    nprobe: int = 8
    n: int = 50
    ef: int = 0
    m: int = 8
    candidates: int = 64
    replicas: int = 8
    eps: float = 0.1
    page_bytes: int = 4096

    def bounded(self, max_nprobe: int = 1 << 16, max_rerank: int = 1 << 20) -> Params:
        """checked(), against the bounds of one index as well."""
        if self.nprobe > max_nprobe or self.n > max_rerank:
            raise ValueError(f"nprobe {self.nprobe} of {max_nprobe}, n {self.n} of {max_rerank}")
        return self.checked()

    def checked(self) -> Params:
        if not (0 < self.k <= 1 << 14 and 0 < self.nprobe <= 1 << 16 and 0 < self.n <= 1 << 20 and self.ef >= 0):
            raise ValueError(f"out of bounds: {self}")
        return self


def read_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.where("vec_id is not null and embedding is not null").select("vec_id", V.quantised(F.col("embedding")).alias("v"))


def query_set(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"))


def heads_of(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 10 = 0").select((F.expr("vec_id div 10")).cast("long").alias("list_id"), F.col("vec_id").alias("head_vec_id"), F.col("v").alias("hv"))


def exact_knn(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """qid, rank, vec_id, dist."""
    out = nearest(queries.select(F.col("qid").alias("id"), F.col("qv").alias("v")), vectors.select(F.col("vec_id").alias("id"), "v"), k)
    return out.select("qid", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "dist")


def assign(vectors: DataFrame, heads: DataFrame, p: Params = Params()) -> DataFrame:
    """Replicated assignment: of the nearest `candidates` heads, those within (1 + eps)^2 of the nearest, at most
    `replicas`. vec_id, list_id, rank, dist. A block of heads sends on only what can be among them."""
    return _closure(nearest(vectors.select(F.col("vec_id").alias("id"), "v"), heads.select(F.col("list_id").alias("id"), F.col("hv").alias("v")), min(p.candidates, p.replicas), within=_factor(p) / 10_000), p)


def _factor(p: Params) -> int:
    return round((1 + p.eps) ** 2 * 10_000)


def _closure(near: DataFrame, p: Params) -> DataFrame:
    first = F.min("dist").over(Window.partitionBy("qid"))
    factor = _factor(p)
    near = near.withColumn("d1", first).where((F.col("dist") * 10_000 <= F.col("d1") * factor) & (F.col("rank") <= p.replicas))
    return near.select(F.col("qid").alias("vec_id"), F.col("id").alias("list_id"), F.col("rank").cast("int").alias("rank"), "dist")


def assign_coarse(vectors: DataFrame, heads: DataFrame, cells: DataFrame, probes: int, p: Params = Params()) -> DataFrame:
    """assign() for many heads: heads lie in their nearest cell, a vector meets the heads of its `probes` nearest cells.

    cells: (id int, v), a few thousand centroids. Work per vector is about probes / cells of all heads, and a vector is copied for each
    of its probes: with all cells probed the answer is assign()'s, which is then the cheaper way."""
    h = nearest(heads.select(F.col("list_id").alias("id"), F.col("hv").alias("v")), cells, 1).select(F.col("id").cast("int").alias("cell"), F.col("qid").alias("id"))
    rows = h.join(heads.select(F.col("list_id").alias("id"), F.col("hv").alias("v")), "id").select("cell", "id", "v")
    v = nearest(vectors.select(F.col("vec_id").alias("id"), "v"), cells, probes).select(F.col("id").cast("int").alias("cell"), F.col("qid").alias("id"))
    asked = v.join(vectors.select(F.col("vec_id").alias("id"), "v"), "id").select("cell", "id", "v")
    return _closure(nearest_in_cells(asked, rows, min(p.candidates, p.replicas), within=_factor(p) / 10_000), p)


def prune_rng(assigned: DataFrame, heads: DataFrame, rng: float = 1.0) -> DataFrame:
    """Relative-neighbourhood pruning of a vector's lists, nearest first: a list goes if a list kept before is nearer to it
    (rng^2 * distance between heads <= distance to the vector). A fold over at most `replicas` lists of one vector."""
    h = heads.select("list_id", "hv")
    lists = assigned.join(h, "list_id").groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("rank", "list_id", "dist", "hv"))).alias("c"))
    ratio = round(rng * rng * 10_000)
    kept = F.aggregate(
        "c",
        F.slice("c", 1, 0),
        lambda acc, x: F.when(F.exists(acc, lambda y: V.l2sqr(x["hv"], y["hv"]) * ratio <= x["dist"] * 10_000), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return lists.select("vec_id", F.posexplode(kept).alias("pos", "x")).select("vec_id", "x.list_id", (F.col("pos") + 1).cast("int").alias("rank"), "x.dist")


def navigate(queries: DataFrame, heads: DataFrame, nprobe: int) -> DataFrame:
    """qid, pos, list_id, dist: the nprobe nearest lists. (A beam width has no effect: the search is exact.)"""
    out = nearest(queries.select(F.col("qid").alias("id"), F.col("qv").alias("v")), heads.select(F.col("list_id").alias("id"), F.col("hv").alias("v")), nprobe)
    return out.select("qid", F.col("rank").cast("int").alias("pos"), F.col("id").alias("list_id"), "dist")


def navigate_graph(queries: DataFrame, heads: DataFrame, graph: tuple[DataFrame, DataFrame], nprobe: int, beam: int = 16) -> tuple[DataFrame, DataFrame]:
    """navigate() by a proximity graph of the heads (graph.build's edges and entries), and qid, seen: how many heads each query met."""
    nodes = heads.select(F.col("list_id").alias("id"), F.col("hv").alias("v"))
    near, seen = proximity.search(queries.select(F.col("qid").alias("id"), F.col("qv").alias("v")), nodes, *graph, nprobe, beam)
    return near.select("qid", F.col("rank").alias("pos"), F.col("id").alias("list_id"), "dist"), seen


def gather(probed: DataFrame, postings: DataFrame, resident: DataFrame | None = None) -> DataFrame:
    """qid, list_id, vec_id, replicas kept. resident: (list_id) held here; any other list raises NotResident."""
    if resident is not None:
        absent = probed.join(resident, "list_id", "left_anti").select("list_id").limit(1).collect()
        if absent:
            raise NotResident(f"list {absent[0][0]}")
    return probed.select("qid", "list_id").join(postings.select("list_id", "vec_id"), "list_id")


def codebook_of(vectors: DataFrame, m: int, codes: int = 256) -> DataFrame:
    """sub, code, c from the vectors of the smallest ids. At most m * codes rows."""
    first = vectors.orderBy("vec_id").limit(codes).withColumn("code", (F.row_number().over(Window.orderBy("vec_id")) - 1).cast("int"))
    width = F.expr(f"cast(size(v) div {m} as int)")
    return first.select("code", "v", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("sub")).select("sub", "code", F.expr("slice(v, sub * w + 1, w)").alias("c"))


def sub_distances(df: DataFrame, key: str, vec: str, codebook: DataFrame, m: int) -> DataFrame:
    """key, sub, code, dist of every sub-vector to every codeword: a join on the sub-space with a table of fixed size."""
    w = F.expr(f"cast(size({vec}) div {m} as int)")
    subs = df.select(key, F.col(vec).alias("__v"), w.alias("__w"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("sub")).select(key, "sub", F.expr("slice(__v, sub * __w + 1, __w)").alias("__s"))
    return subs.join(F.broadcast(codebook), "sub").select(key, "sub", "code", V.l2sqr(F.col("__s"), F.col("c")).alias("dist"))


def codewords(codebook: DataFrame, m: int) -> np.ndarray:
    """The codebook as (sub, code, component), on the driver: its size is fixed, m * 256 codewords at most."""
    rows = sorted((r["sub"], r["code"], r["c"]) for r in codebook.collect())
    return np.array([r[2] for r in rows], float).reshape(m, len(rows) // m, -1)


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)


def _slices(batches, size: int):
    """The batches, at most size rows at a time: what a task works out of them grows with no setting and no table."""
    for b in batches:
        for i in range(0, b.num_rows, size):
            yield b.slice(i, size)


def sub_space_distances(x: np.ndarray, words: np.ndarray):
    """For each sub-space, squared distances (row, code); exact, as all numbers are integers below 2^53."""
    d = words.shape[2]
    for i, w in enumerate(words):
        s = x[:, i * d : (i + 1) * d]
        yield (s * s).sum(axis=1)[:, None] + (w * w).sum(axis=1)[None] - 2 * (s @ w.T)


def encode(vectors: DataFrame, codebook: DataFrame, m: int) -> DataFrame:
    """vec_id, code (array of m): the nearest codeword of each sub-space, the smallest on ties. No shuffle."""
    ship(codebook.sparkSession)
    words = codewords(codebook, m)

    def run(batches):
        for b in _slices(batches, 1024):
            if b.num_rows:
                best = np.stack([d.argmin(axis=1) for d in sub_space_distances(_matrix(b.column(1)), words)], axis=1)
                codes = pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, m), "int32"), pa.array(best.astype("int32").ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), codes], ["vec_id", "code"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id bigint, code array<int>")


def decode(codes: DataFrame, codebook: DataFrame) -> DataFrame:
    """vec_id, v: codewords laid end to end."""
    parts = codes.select("vec_id", F.posexplode("code").alias("sub", "code")).join(F.broadcast(codebook), ["sub", "code"])
    return parts.groupBy("vec_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("sub", "c"))), lambda x: x["c"])).alias("v"))


def distance_tables(queries: DataFrame, codebook: DataFrame, m: int) -> DataFrame:
    """qid, lut (m arrays of a distance per code). No shuffle."""
    ship(codebook.sparkSession)
    words = codewords(codebook, m)

    def run(batches):
        for b in _slices(batches, 128):
            if b.num_rows:
                lut = np.stack(list(sub_space_distances(_matrix(b.column(1)), words)), axis=1)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, lut.size + 1, lut.shape[2]), "int32"), pa.array(np.rint(lut).astype("int64").ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) + 1, m), "int32"), rows)], ["qid", "lut"])

    return queries.select("qid", "qv").mapInArrow(run, "qid bigint, lut array<array<bigint>>")


def score(candidates: DataFrame, codes: DataFrame, luts: DataFrame, m: int = 0) -> DataFrame:
    """(key columns..., qid, vec_id) with adc. m: sub-spaces, if known, for an expression without lambdas."""
    adc = V.adc_unrolled(F.col("lut"), F.col("code"), m) if m else V.adc(F.col("lut"), F.col("code"))
    return candidates.join(codes, "vec_id").join(luts, "qid").withColumn("adc", adc).drop("lut", "code")


def top(df: DataFrame, by: str, n: int, keys=("qid",), name: str = "rank") -> DataFrame:
    """The n first rows per key by (by, vec_id)."""
    w = Window.partitionBy(*keys).orderBy(by, "vec_id")
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n).withColumn(name, F.col(name).cast("int"))


def filter_stage(gathered: DataFrame, codes: DataFrame, luts: DataFrame, n: int, keys=("qid",), m: int = 0) -> DataFrame:
    """Dedup, asymmetric distance, first n: keys, vec_id, adc, rank."""
    return top(score(gathered.select(*keys, "vec_id").distinct(), codes, luts, m), "adc", n, keys)


def exact_scores(filtered: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds dist. The vectors come last, joined on the id of what passed the filter."""
    joined = filtered.join(vectors, "vec_id").join(queries, "qid")
    return joined.withColumn("dist", V.l2sqr(F.col("qv"), F.col("v"))).drop("v", "qv")


def rerank(filtered: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, keys=("qid",)) -> DataFrame:
    """keys, rank, vec_id, dist."""
    scored = exact_scores(filtered.drop("rank"), vectors, queries)
    return top(scored, "dist", k, keys).select(*keys, "rank", "vec_id", "dist")


def heuristic_rerank(filtered: DataFrame, vectors: DataFrame, queries: DataFrame, layout: DataFrame, k: int, batch: int = 0, eps: float = 0.1, beta: int = 1, io_dedup: bool = True) -> DataFrame:
    """Re-ranking in mini-batches that stops once the k best are stable; a row per query.

    filtered: qid, vec_id, rank (by asymmetric distance). layout: vec_id, page. After batch b the k best of the batches so far are
    S_b; a batch is stable if S_b holds k and at most eps * k of it is new; the batch that ends beta stable ones in
    a row is the last. Returns qid, batches, reranked, pages_read, intra_merged, buffer_hits, ids (k best, in order)."""
    size = batch or k
    c = exact_scores(filtered.select("qid", "vec_id", F.expr(f"cast((rank - 1) div {size} as int)").alias("b")), vectors, queries).join(layout.select("vec_id", "page"), "vec_id")
    c = c.select("qid", "vec_id", "b", "dist", "page")
    # batch by batch, the k best so far: linear in a query's candidates, of which there are n at most
    by_batch = c.groupBy("qid", "b").agg(F.collect_list(F.struct("dist", "vec_id")).alias("items"))
    all_of = by_batch.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("b", "items"))).alias("x"))
    none = F.expr("named_struct('best', cast(array() as array<struct<dist:bigint,vec_id:bigint>>), 'streak', 0, 'stop', -1)")

    def step(state, x):
        best = F.slice(F.sort_array(F.concat(state["best"], x["items"])), 1, k)
        stable = (F.size(best) >= k) & (F.size(F.array_intersect(best, x["items"])) <= F.lit(eps) * k)
        streak = F.when(stable, state["streak"] + 1).otherwise(F.lit(0))
        after = F.struct(best.alias("best"), streak.alias("streak"), F.when(streak >= beta, x["b"]).otherwise(F.lit(-1)).alias("stop"))
        return F.when(state["stop"] >= 0, state).otherwise(after)

    end = all_of.select("qid", F.array_max("x.b").alias("bmax"), F.aggregate("x", none, step).alias("s"))
    end = end.select("qid", F.when(F.col("s.stop") >= 0, F.col("s.stop")).otherwise(F.col("bmax")).alias("stop"), F.col("s.best.vec_id").alias("ids"))
    stop = end.select("qid", "stop")
    done = c.join(stop, "qid").where("b <= stop")
    first = F.min("b").over(Window.partitionBy("qid", "page"))
    place = F.row_number().over(Window.partitionBy("qid", "page").orderBy("b", "vec_id"))
    done = done.withColumn("fb", first).withColumn("nth", place)
    if io_dedup:
        read, intra, hit = F.col("nth") == 1, (F.col("nth") > 1) & (F.col("b") == F.col("fb")), F.col("b") > F.col("fb")
    else:
        read, intra, hit = F.lit(True), F.lit(False), F.lit(False)
    cnt = lambda x, name: F.sum(x.cast("long")).alias(name)
    stats = done.groupBy("qid").agg((F.max("stop") + 1).cast("long").alias("batches"), F.count("*").alias("reranked"), cnt(read, "pages_read"), cnt(intra, "intra_merged"), cnt(hit, "buffer_hits"))
    return stats.join(end.select("qid", "ids"), "qid")


# --- layout ----------------------------------------------------------------------------------------------------


def bucket_layout(primary: DataFrame, vpp: int) -> DataFrame:
    """vec_id, page, slot, loc: full pages per primary list in list order, then the tails packed largest first,
    best fit, never split, first in first out within a size.

    The packing depends only on how many tails there are of each size (under vpp numbers, worked out on the driver); tails
    then find their page by their number within their size."""
    w = Window.partitionBy("list_id").orderBy("vec_id")
    m = primary.select("vec_id", "list_id").withColumn("pos", F.row_number().over(w) - 1).withColumn("size", F.count("*").over(Window.partitionBy("list_id")))
    m = m.withColumn("full", F.expr(f"size div {vpp}"))
    lists = m.groupBy("list_id").agg(F.first("full").alias("full"), F.first("size").alias("size"))
    starts = prefix_sums(lists, [F.col("list_id")], F.col("full"), "start").withColumn("tail", F.col("size") % vpp)
    # numbered over (size, list): within its size a tail's number is that less the tails of smaller sizes
    tails = numbered(starts.where("tail > 0"), [F.col("tail"), F.col("list_id")], "nth")
    first = tails.groupBy("tail").agg(F.min("nth").alias("first"))
    tails = tails.join(F.broadcast(first), "tail").withColumn("nth", F.col("nth") - F.col("first")).drop("first")
    counts = {r["tail"]: r["n"] for r in tails.groupBy("tail").agg(F.count("*").alias("n")).collect()}
    full_pages = starts.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]
    places = pack_tails(counts, vpp)
    spark = primary.sparkSession
    placed = spark.createDataFrame(places, "tail long, lo long, hi long, page0 long, slot0 long")
    tails = tails.join(F.broadcast(placed), (tails["tail"] == placed["tail"]) & (F.col("nth") >= F.col("lo")) & (F.col("nth") < F.col("hi"))).select("list_id", (F.col("page0") + F.col("nth") - F.col("lo") + full_pages).alias("tpage"), F.col("slot0").alias("tslot"))
    out = m.join(starts.select("list_id", "start"), "list_id").join(tails, "list_id", "left")
    in_full = F.col("pos") < F.col("full") * vpp
    page = F.when(in_full, F.col("start") + F.expr(f"pos div {vpp}")).otherwise(F.col("tpage")).cast("long")
    slot = F.when(in_full, F.col("pos") % vpp).otherwise(F.col("tslot") + F.col("pos") - F.col("full") * vpp).cast("long")
    return out.select("vec_id", page.alias("page"), slot.alias("slot"), (page * vpp + slot).alias("loc"))


def pack_tails(counts: dict[int, int], vpp: int) -> list[tuple[int, int, int, int, int]]:
    """Runs of tails: (size, from tail number, to, first page, slot), one tail a page in a row of pages.

    A page takes the largest size there is that still fits, again and again. What it takes depends only on which sizes are
    left, so the same page is repeated while its sizes last; a size of which a page takes several is dealt to each page in
    turn, one page at a time."""
    left = Counter({s: n for s, n in counts.items() if n > 0})
    given: Counter = Counter()
    runs, page = [], 0
    while left:
        slots, free = [], vpp
        rest = Counter(left)
        while sizes := [s for s in rest if s <= free]:
            slots.append((max(sizes), vpp - free))
            free -= slots[-1][0]
            rest -= Counter([slots[-1][0]])
        need = Counter(s for s, _ in slots)
        pages = min(left[s] for s in need) if max(need.values()) == 1 else 1
        for s, slot in slots:
            runs.append((s, given[s], given[s] + pages, page, slot))
            given[s] += pages
        left -= Counter({s: n * pages for s, n in need.items()})
        page += pages
    return runs


def sequential_layout(vectors: DataFrame, vpp: int) -> DataFrame:
    return vectors.select("vec_id", F.expr(f"vec_id div {vpp}").cast("long").alias("page"), (F.col("vec_id") % vpp).alias("slot"), F.col("vec_id").alias("loc"))
