"""Registered queries of the index, the search and its variants over several owners."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.folders import shared
from spindrift.operators import distributed as D
from spindrift.operators import index as I
from spindrift.operators import train
from spindrift.operators.blocks import all_pairs
from spindrift.plans.declare import query
from spindrift.sources.index_dir import IndexDir

P = I.Params()
VPP = 16
PARTS, NODES = 8, 3


def l2(a: str, b: str) -> str:
    return f"CAST(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"


_owner = f"CASE WHEN part < 3 THEN 0 WHEN part < 6 THEN 1 ELSE 2 END"
CTE = {
    "v": "SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings",
    "q": "SELECT vec_id AS qid, v AS qv FROM v WHERE vec_id % 50 = 0",
    "h": "SELECT vec_id // 10 AS list_id, vec_id AS head_vec_id, v AS hv FROM v WHERE vec_id % 10 = 0",
    "gt": f"SELECT * FROM (SELECT qid, vec_id, dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS INTEGER) AS rank FROM (SELECT qid, vec_id, {l2('qv', 'v')} AS dist FROM q, v)) WHERE rank <= 10",
    "near": f"SELECT vec_id, list_id, dist, row_number() OVER (PARTITION BY vec_id ORDER BY dist, list_id) AS rn FROM (SELECT vec_id, list_id, {l2('v', 'hv')} AS dist FROM v, h)",
    "post": "SELECT n.vec_id, n.list_id, CAST(n.rn AS INTEGER) AS rank, n.dist FROM near n JOIN (SELECT vec_id, dist AS d1 FROM near WHERE rn = 1) USING (vec_id) WHERE rn <= 8 AND dist * 10000 <= d1 * 12100",
    "nav": f"SELECT * FROM (SELECT qid, list_id, dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, list_id) AS INTEGER) AS pos FROM (SELECT qid, list_id, {l2('qv', 'hv')} AS dist FROM q, h)) WHERE pos <= 8",
    "cb": "SELECT CAST(s.sub AS INTEGER) AS sub, CAST(code AS INTEGER) AS code, v[s.sub * (len(v) // 8) + 1 : (s.sub + 1) * (len(v) // 8)] AS c FROM (SELECT v, row_number() OVER (ORDER BY vec_id) - 1 AS code FROM v ORDER BY vec_id LIMIT 256), (SELECT unnest(range(8)) AS sub) s",
    "codes1": f"SELECT vec_id, sub, code FROM (SELECT vec_id, cb.sub, cb.code, row_number() OVER (PARTITION BY vec_id, cb.sub ORDER BY {l2('v[cb.sub * (len(v) // 8) + 1 : (cb.sub + 1) * (len(v) // 8)]', 'c')}, cb.code) AS r FROM v, cb) WHERE r = 1",
    "lut1": f"SELECT qid, cb.sub, cb.code, {l2('qv[cb.sub * (len(qv) // 8) + 1 : (cb.sub + 1) * (len(qv) // 8)]', 'c')} AS dist FROM q, cb",
    "gathered": "SELECT qid, nav.list_id, vec_id FROM nav JOIN post USING (list_id)",
    "cand": "SELECT DISTINCT qid, vec_id FROM gathered",
    "scored": "SELECT qid, vec_id, CAST(sum(l.dist) AS BIGINT) AS adc FROM cand JOIN codes1 c USING (vec_id) JOIN lut1 l USING (qid, sub, code) GROUP BY qid, vec_id",
    "filt": "SELECT * FROM (SELECT qid, vec_id, adc, CAST(row_number() OVER (PARTITION BY qid ORDER BY adc, vec_id) AS INTEGER) AS rank FROM scored) WHERE rank <= 50",
    "exact": f"SELECT f.qid, f.vec_id, f.adc, f.rank AS arank, {l2('qv', 'v')} AS dist FROM filt f JOIN q USING (qid) JOIN v USING (vec_id)",
    "ans": "SELECT * FROM (SELECT qid, vec_id, dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS INTEGER) AS rank FROM exact) WHERE rank <= 10",
    "lp": f"SELECT list_id, CAST(list_id * {PARTS} // (SELECT max(list_id) + 1 FROM h) AS INTEGER) AS part FROM h",
    "pl": f"SELECT CAST(part AS INTEGER) AS part, CAST({_owner} AS INTEGER) AS node FROM (SELECT unnest(range({PARTS})) AS part)",
    "own": "SELECT nav.qid, nav.pos, nav.list_id, node FROM nav JOIN lp USING (list_id) JOIN pl USING (part)",
    "ocand": "SELECT DISTINCT own.qid, node, vec_id FROM own JOIN post USING (list_id)",
    "oscored": "SELECT o.qid, node, vec_id, adc FROM ocand o JOIN scored USING (qid, vec_id)",
    "ofilt": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, node ORDER BY adc, vec_id) AS r FROM oscored) WHERE r <= 50",
    "merged": "SELECT * FROM (SELECT qid, vec_id, min(adc) AS adc, min(node) AS node, row_number() OVER (PARTITION BY qid ORDER BY min(adc), vec_id) AS r FROM ofilt GROUP BY qid, vec_id) WHERE r <= 50",
    "prim": "SELECT vec_id, list_id FROM post WHERE rank = 1",
    "seqlay": f"SELECT vec_id, vec_id // {VPP} AS page, vec_id % {VPP} AS slot, vec_id AS loc FROM v",
}
NEEDS = {
    "q": ["v"], "h": ["v"], "gt": ["q", "v"], "near": ["v", "h"], "post": ["near"], "nav": ["q", "h"], "cb": ["v"], "codes1": ["v", "cb"], "lut1": ["q", "cb"],
    "gathered": ["nav", "post"], "cand": ["gathered"], "scored": ["cand", "codes1", "lut1"], "filt": ["scored"], "exact": ["filt", "q", "v"], "ans": ["exact"],
    "lp": ["h"], "own": ["nav", "lp", "pl"], "ocand": ["own", "post"], "oscored": ["ocand", "scored"], "ofilt": ["oscored"], "merged": ["ofilt"], "prim": ["post"], "seqlay": ["v"],
}


def sql(body: str, *names: str, **extra: str) -> str:
    """body after the tables that it needs."""
    order: list[str] = []

    def need(n):
        for x in NEEDS.get(n, []):
            need(x)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    parts = [f"{n} AS MATERIALIZED ({CTE[n]})" for n in order] + [f"{n} AS ({x})" for n, x in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


class Tables:
    """The recipe's tables over one data directory; each is worked out when asked for."""

    def __init__(self, spark, sf_dir):
        self.spark = spark
        self.v = I.read_vectors(spark, sf_dir)
        self.q, self.h = I.query_set(self.v), I.heads_of(self.v)

    def post(self):
        return I.assign(self.v, self.h, P)

    def nav(self):
        return I.navigate(self.q, self.h, P.nprobe)

    def cb(self):
        return I.codebook_of(self.v, P.m)

    def codes(self):
        return I.encode(self.v, self.cb(), P.m)

    def luts(self):
        return I.distance_tables(self.q, self.cb(), P.m)

    def gathered(self):
        return I.gather(self.nav(), self.post())

    def filt(self):
        return I.filter_stage(self.gathered(), self.codes(), self.luts(), P.n, m=P.m)

    def lp(self):
        return D.range_partitions(self.h, PARTS)

    def pl(self):
        return D.even_placement(self.spark, PARTS, [0, 1, 2])

    def own(self):
        return D.group_by_owner(self.nav(), self.lp(), self.pl())


_folders: dict[tuple[str, str], IndexDir] = {}


def folder(spark, sf) -> IndexDir:
    """The recipe's index as a folder of tables, built once per application and data."""
    key = spark.sparkContext.applicationId, sf
    if key not in _folders:
        d = IndexDir(spark, shared(spark, "index"))
        d.build(I.read_vectors(spark, sf), parts=PARTS, vpp=VPP)
        d.segment()
        _folders[key] = d
    return _folders[key]


class Built(Tables):
    """The recipe's tables with what a build leaves read from its folder: a search does not build anything."""

    def __init__(self, spark, sf_dir):
        super().__init__(spark, sf_dir)
        self.dir = folder(spark, sf_dir)
        self.h = self.dir.read("heads")

    def post(self):
        return self.dir.read("postings")

    def cb(self):
        return self.dir.read("codebook")

    def codes(self):
        return self.dir.read("codes")

    def lp(self):
        return self.dir.read("list_part")


@query("J1_exact_knn", sql("SELECT qid, rank, vec_id, dist FROM gt", "gt"))
def exact_knn(spark, sf):
    t = Tables(spark, sf)
    return I.exact_knn(t.q, t.v, P.k)


def _pairs(queries, rows):
    """qid, vec_id, dist of two tables of an id and a vector."""
    of = lambda df: df.select(F.col(df.columns[0]).alias("id"), F.col(df.columns[1]).cast("array<double>").alias("v"))
    return all_pairs(of(queries), of(rows)).withColumnRenamed("id", "vec_id")


@query("P1_l2_int", sql(f"SELECT qid, vec_id, {l2('qv', 'v')} AS dist FROM q, v", "q", "v"))
def l2_int(spark, sf):
    t = Tables(spark, sf)
    return _pairs(t.q.select("qid", "qv"), t.v).withColumn("dist", F.col("dist").cast("long"))


@query("P2_l2_float", """SELECT a.vec_id AS qid, b.vec_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) AS dist
FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0""")
def l2_float(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    return _pairs(e.where("vec_id % 50 = 0"), e)


@query("B6_nearest_head", sql("SELECT vec_id, list_id, dist FROM near WHERE rn = 1", "near"))
def nearest_head(spark, sf):
    t = Tables(spark, sf)
    return I.assign(t.v, t.h, I.Params(candidates=1, replicas=1)).select("vec_id", "list_id", "dist")


@query("B13_assign", sql("SELECT vec_id, list_id, rank, dist FROM post", "post"))
def assign(spark, sf):
    return Tables(spark, sf).post()


_PRUNED = f"""WITH RECURSIVE blk AS MATERIALIZED (
  SELECT p.vec_id, p.rank, p.list_id, coalesce(list(o.list_id) FILTER (WHERE o.list_id IS NOT NULL AND {l2('hp.hv', 'ho.hv')} <= p.dist), CAST([] AS BIGINT[])) AS blockers
  FROM post p JOIN h hp ON hp.list_id = p.list_id LEFT JOIN post o ON o.vec_id = p.vec_id AND o.rank < p.rank LEFT JOIN h ho ON ho.list_id = o.list_id GROUP BY p.vec_id, p.rank, p.list_id),
r(vec_id, rank, kept) AS (
  SELECT vec_id, 0, CAST([] AS BIGINT[]) FROM v
  UNION ALL SELECT b.vec_id, b.rank, CASE WHEN list_has_any(kept, blockers) THEN kept ELSE list_append(kept, b.list_id) END FROM r JOIN blk b ON b.vec_id = r.vec_id AND b.rank = r.rank + 1),
l AS (SELECT vec_id, arg_max(kept, rank) AS kept FROM r GROUP BY vec_id),
u AS (SELECT vec_id, unnest(kept) AS list_id, unnest(range(1, len(kept) + 1)) AS rank FROM l)
SELECT u.vec_id, u.list_id, CAST(u.rank AS INTEGER) AS rank, p.dist FROM u JOIN post p ON p.vec_id = u.vec_id AND p.list_id = u.list_id"""


@query("B14_rng_prune", sql("", "post", "h").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + _PRUNED.removeprefix("WITH RECURSIVE "))
def rng_prune(spark, sf):
    t = Tables(spark, sf)
    return I.prune_rng(t.post(), t.h)


@query("B15_primary", sql("SELECT vec_id, list_id FROM post WHERE rank = 1", "post"))
def primary(spark, sf):
    return Tables(spark, sf).post().where("rank = 1").select("vec_id", "list_id")


@query("B16_lists", sql("SELECT list_id, list_sort(list(vec_id)) AS vec_ids FROM post GROUP BY list_id", "post"))
def lists(spark, sf):
    return Tables(spark, sf).post().groupBy("list_id").agg(F.sort_array(F.collect_list("vec_id")).alias("vec_ids"))


@query("B17_assign_stats", sql("SELECT count(*) AS lists, CAST(sum(n) AS BIGINT) AS postings, min(n) AS least, max(n) AS most, count(*) FILTER (WHERE n = 0) AS empty FROM (SELECT h.list_id, count(p.vec_id) AS n FROM h LEFT JOIN post p USING (list_id) GROUP BY h.list_id)", "h", "post"))
def assign_stats(spark, sf):
    t = Tables(spark, sf)
    n = t.h.select("list_id").join(t.post(), "list_id", "left").groupBy("list_id").agg(F.count("vec_id").alias("n"))
    return n.agg(F.count("*").alias("lists"), F.sum("n").alias("postings"), F.min("n").alias("least"), F.max("n").alias("most"), F.count_if(F.col("n") == 0).alias("empty"))


@query("B3_lloyd_step", sql("""SELECT n.list_id, d.dim, CAST(sum(v.v[d.dim + 1]) AS BIGINT) AS total, count(*) AS members
FROM near n JOIN v USING (vec_id), (SELECT CAST(unnest(range(64)) AS INTEGER) AS dim) d WHERE n.rn = 1 GROUP BY n.list_id, d.dim""", "near", "v"))
def lloyd_step(spark, sf):
    t = Tables(spark, sf)
    return train.lloyd_sums(t.v, t.h)


@query("B4_balanced_argmin", sql(f"""SELECT vec_id, list_id FROM (
  SELECT vec_id, list_id, row_number() OVER (PARTITION BY vec_id ORDER BY dist * 100 + size * 5000, list_id) AS r
  FROM near JOIN (SELECT h.list_id, count(n.vec_id) AS size FROM h LEFT JOIN (SELECT * FROM near WHERE rn = 1) n USING (list_id) GROUP BY h.list_id) USING (list_id)) WHERE r = 1""", "near", "h"))
def balanced(spark, sf):
    t = Tables(spark, sf)
    return train.balanced_assignment(t.v, t.h, 50)


@query("B10_leaf_heads", sql("""SELECT list_id, vec_id AS head_vec_id FROM (
  SELECT m.list_id, v.vec_id, row_number() OVER (PARTITION BY m.list_id ORDER BY list_sum(list_transform(list_zip(v.v, m.total), lambda p: (p[1] * m.n - p[2]) * (p[1] * m.n - p[2]))), v.vec_id) AS r
  FROM (SELECT list_id, any_value(n) AS n, list(total ORDER BY dim) AS total FROM (SELECT n.list_id, d.dim, sum(v.v[d.dim + 1])::BIGINT AS total, count(*) AS n FROM near n JOIN v USING (vec_id), (SELECT unnest(range(64)) AS dim) d WHERE rn = 1 GROUP BY 1, 2) GROUP BY list_id) m
  JOIN near n2 ON n2.list_id = m.list_id AND n2.rn = 1 JOIN v ON v.vec_id = n2.vec_id) WHERE r = 1""", "near", "v"))
def leaf_heads(spark, sf):
    t = Tables(spark, sf)
    return train.leaf_heads(t.v, nearest_head(spark, sf).select("vec_id", "list_id"))


@query("B1_sample", sql("SELECT vec_id FROM v ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42'), vec_id LIMIT 128", "v"))
def sample(spark, sf):
    return train.sample_ids(Tables(spark, sf).v, 128)


@query("B19_encode", sql("SELECT vec_id, list(code ORDER BY sub) AS code FROM codes1 GROUP BY vec_id", "codes1"))
def encode(spark, sf):
    return Tables(spark, sf).codes()


@query("B20_decode", sql("SELECT vec_id, flatten(list(c ORDER BY codes1.sub)) AS v FROM codes1 JOIN cb USING (sub, code) GROUP BY vec_id", "codes1", "cb"))
def decode(spark, sf):
    t = Tables(spark, sf)
    return I.decode(t.codes(), t.cb())


@query("P3_l2_mixed", sql("SELECT q.qid, b.vec_id, list_sum(list_transform(list_zip(qv, embedding), lambda p: (CAST(p[1] AS DOUBLE) / 256 - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) / 256 - CAST(p[2] AS DOUBLE)))) AS dist FROM q, embeddings b", "q"))
def l2_mixed(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    typed = F.transform("qv", lambda x: x.cast("double") / F.lit(256.0)).alias("v")
    return _pairs(Tables(spark, sf).q.select("qid", typed), e)


@query("P4_lut", sql("SELECT qid, sub, code, dist FROM lut1", "lut1"))
def lut(spark, sf):
    t = Tables(spark, sf)
    return I.sub_distances(t.q, "qid", "qv", t.cb(), P.m)


@query("P5_adc", sql("SELECT qid, vec_id, adc FROM scored", "scored"))
def adc(spark, sf):
    t = Built(spark, sf)
    return I.score(t.gathered().select("qid", "vec_id").distinct(), t.codes(), t.luts())


@query("J2_navigate", sql("SELECT qid, pos, list_id, dist FROM nav", "nav"))
def navigate(spark, sf):
    return Tables(spark, sf).nav()


@query("J3_gather", sql("SELECT qid, list_id, vec_id FROM gathered", "gathered"))
def gather(spark, sf):
    return Built(spark, sf).gathered()


@query("A1_dedup", sql("SELECT qid, count(*) AS gathered, count(DISTINCT vec_id) AS uniq FROM gathered GROUP BY qid", "gathered"))
def dedup(spark, sf):
    g = Built(spark, sf).gathered().groupBy("qid", "vec_id").agg(F.count("*").alias("n"))
    return g.groupBy("qid").agg(F.sum("n").alias("gathered"), F.count("*").alias("uniq"))


@query("R1_filter", sql("SELECT qid, vec_id, adc, rank FROM filt", "filt"))
def filt(spark, sf):
    return Built(spark, sf).filt()


@query("J5_exact_scores", sql("SELECT qid, vec_id, adc, dist FROM exact", "exact"))
def exact_scores(spark, sf):
    t = Built(spark, sf)
    return I.exact_scores(t.filt().drop("rank"), t.v, t.q)


@query("R3_rerank", sql("SELECT qid, rank, vec_id, dist FROM ans", "ans"))
@query("R6_search", sql("SELECT qid, rank, vec_id, dist FROM ans", "ans"))
def search(spark, sf):
    t = Built(spark, sf)
    return I.rerank(t.filt(), t.v, t.q, P.k)


_heur = f"""b AS (SELECT e.qid, e.vec_id, e.dist, (e.arank - 1) // 10 AS b, l.page FROM exact e JOIN seqlay l USING (vec_id)),
steps AS (SELECT qid, unnest(range(max(b) + 1)) AS step FROM b GROUP BY qid),
s AS (SELECT * FROM (SELECT b.qid, step, b.b, vec_id, row_number() OVER (PARTITION BY b.qid, step ORDER BY dist, vec_id) AS r FROM b JOIN steps ON b.qid = steps.qid AND b.b <= step) WHERE r <= 10),
st AS (SELECT s.qid, s.step, count(*) AS held, count(*) FILTER (WHERE p.vec_id IS NULL) AS new FROM s LEFT JOIN s p ON p.qid = s.qid AND p.step = s.step - 1 AND p.vec_id = s.vec_id GROUP BY s.qid, s.step),
stop AS (SELECT qid, coalesce(min(step) FILTER (WHERE held >= 10 AND new <= 1), max(step)) AS stop FROM st GROUP BY qid),
done AS (SELECT b.*, stop, min(b) OVER (PARTITION BY b.qid, page) AS fb, row_number() OVER (PARTITION BY b.qid, page ORDER BY b, vec_id) AS nth FROM b JOIN stop ON b.qid = stop.qid AND b <= stop)"""


@query("R4_heuristic_rerank", sql("SELECT d.qid, max(stop) + 1 AS batches, count(*) AS reranked, (SELECT list(vec_id ORDER BY r) FROM s WHERE s.qid = d.qid AND s.step = max(d.stop)) AS ids FROM done d GROUP BY d.qid", "exact", "seqlay").replace("\nSELECT d.qid", ",\n" + _heur + "\nSELECT d.qid", 1))
def heuristic(spark, sf):
    t = Built(spark, sf)
    return I.heuristic_rerank(t.filt(), t.v, t.q, I.sequential_layout(t.v, VPP), P.k).select("qid", "batches", "reranked", "ids")


@query("R5_io_counters", sql("SELECT qid, count(*) FILTER (WHERE nth = 1) AS pages_read, count(*) FILTER (WHERE nth > 1 AND b = fb) AS intra_merged, count(*) FILTER (WHERE b > fb) AS buffer_hits FROM done GROUP BY qid", "exact", "seqlay").replace("\nSELECT qid", ",\n" + _heur + "\nSELECT qid", 1))
def io_counters(spark, sf):
    t = Built(spark, sf)
    return I.heuristic_rerank(t.filt(), t.v, t.q, I.sequential_layout(t.v, VPP), P.k).select("qid", "pages_read", "intra_merged", "buffer_hits")


@query("A4_recall", sql("SELECT count(*) AS queries, round(avg(CAST(hit AS DOUBLE) / 10), 6) AS recall FROM (SELECT g.qid, count(a.vec_id) AS hit FROM gt g LEFT JOIN ans a ON a.qid = g.qid AND a.vec_id = g.vec_id GROUP BY g.qid)", "gt", "ans"))
def recall(spark, sf):
    return D.recall(exact_knn(spark, sf), search(spark, sf), P.k)


@query("A5_recall_ties", sql("SELECT a.qid, count(*) FILTER (WHERE a.dist <= k.dist) AS hits FROM ans a JOIN (SELECT qid, max(dist) AS dist FROM gt GROUP BY qid) k USING (qid) GROUP BY a.qid", "gt", "ans"))
def recall_ties(spark, sf):
    return D.recall_by_distance(exact_knn(spark, sf), search(spark, sf))


@query("A6_query_stats", sql("""SELECT round(avg(lists), 6) AS lists, round(avg(cand), 6) AS cand, round(avg(uniq), 6) AS uniq, round(avg(topn), 6) AS topn FROM (
  SELECT g.qid, count(DISTINCT list_id) AS lists, count(*) AS cand, count(DISTINCT g.vec_id) AS uniq, any_value(f.n) AS topn FROM gathered g JOIN (SELECT qid, count(*) AS n FROM filt GROUP BY qid) f USING (qid) GROUP BY g.qid)""", "gathered", "filt"))
def query_stats(spark, sf):
    t = Built(spark, sf)
    f = t.filt().groupBy("qid").agg(F.count("*").alias("n"))
    g = t.gathered().groupBy("qid").agg(F.countDistinct("list_id").alias("lists"), F.count("*").alias("cand"), F.countDistinct("vec_id").alias("uniq")).join(f, "qid")
    return g.agg(*[F.round(F.avg(c), 6).alias(n) for c, n in (("lists", "lists"), ("cand", "cand"), ("uniq", "uniq"), ("n", "topn"))])


@query("A6_rerank_stats", sql("SELECT round(avg(batches), 6) AS batches, round(avg(reranked), 6) AS reranked, round(avg(pages), 6) AS pages, round(avg(merged), 6) AS merged, round(avg(hits), 6) AS hits FROM (SELECT qid, max(stop) + 1 AS batches, count(*) AS reranked, count(*) FILTER (WHERE nth = 1) AS pages, count(*) FILTER (WHERE nth > 1 AND b = fb) AS merged, count(*) FILTER (WHERE b > fb) AS hits FROM done GROUP BY qid)", "exact", "seqlay").replace("\nSELECT round", ",\n" + _heur + "\nSELECT round", 1))
def rerank_stats(spark, sf):
    """Means over queries of what the heuristic re-ranking did."""
    t = Built(spark, sf)
    done = I.heuristic_rerank(t.filt(), t.v, t.q, I.sequential_layout(t.v, VPP), P.k)
    return done.agg(*[F.round(F.avg(c), 6).alias(n) for c, n in (("batches", "batches"), ("reranked", "reranked"), ("pages_read", "pages"), ("intra_merged", "merged"), ("buffer_hits", "hits"))])


@query("A15_max_candidates", sql("SELECT CAST(sum(n) AS BIGINT) AS bound FROM (SELECT count(*) AS n FROM post GROUP BY list_id ORDER BY n DESC LIMIT 8)", "post"))
def max_candidates(spark, sf):
    n = Built(spark, sf).post().groupBy("list_id").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n")).limit(P.nprobe).agg(F.sum("n").alias("bound"))


@query("R12_sweep", """WITH """ + sql("X", "nav", "post", "codes1", "lut1", "gt", "q", "v").removeprefix("WITH ").removesuffix("X") + f""",
p AS (SELECT * FROM (VALUES (2, 20), (4, 50), (8, 50)) p(nprobe, n)),
sc AS (SELECT p.nprobe, p.n, c.qid, c.vec_id, sum(l.dist) AS adc FROM p JOIN (SELECT DISTINCT p.nprobe, p.n, nav.qid, post.vec_id FROM p JOIN nav ON nav.pos <= p.nprobe JOIN post USING (list_id)) c USING (nprobe, n) JOIN codes1 USING (vec_id) JOIN lut1 l USING (qid, sub, code) GROUP BY ALL),
fi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nprobe, n, qid ORDER BY adc, vec_id) AS r FROM sc) WHERE r <= n),
ex AS (SELECT fi.*, row_number() OVER (PARTITION BY nprobe, n, fi.qid ORDER BY {l2('qv', 'v')}, fi.vec_id) AS e FROM fi JOIN q USING (qid) JOIN v USING (vec_id))
SELECT CAST(nprobe AS INTEGER) AS nprobe, CAST(n AS INTEGER) AS n, count(*) AS answers, count(gt.vec_id) AS hits FROM ex LEFT JOIN gt ON gt.qid = ex.qid AND gt.vec_id = ex.vec_id WHERE e <= 10 GROUP BY nprobe, n""")
def sweep(spark, sf):
    t = Built(spark, sf)
    return D.sweep(t, [(2, 20), (4, 50), (8, 50)], exact_knn(spark, sf))


@query("B11_cluster_stats", sql("SELECT count(*) AS leaves, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT count(*) AS n FROM near WHERE rn = 1 GROUP BY list_id)", "near"))
def cluster_stats(spark, sf):
    n = nearest_head(spark, sf).groupBy("list_id").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("leaves"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


@query("R8_fused_calls", sql("SELECT qid, CAST(sum(1) AS BIGINT) AS owners, CASE WHEN count(*) = 1 THEN 1 ELSE count(*) + any_value(r) END AS calls FROM (SELECT own.qid, node FROM own GROUP BY own.qid, node) JOIN (SELECT qid, count(DISTINCT node) AS r FROM merged GROUP BY qid) USING (qid) GROUP BY qid", "own", "merged"))
def fused_calls(spark, sf):
    """Calls of the two-phase plan that fuses both phases where one node owns all lists."""
    t = Built(spark, sf)
    own = t.own()
    second = D.merge_origin(D.owner_filter(own, t.post(), t.codes(), t.luts(), P.n), P.n).groupBy("qid").agg(F.countDistinct("node").alias("r"))
    n = own.groupBy("qid").agg(F.countDistinct("node").alias("owners")).join(second, "qid")
    return n.select("qid", "owners", F.when(F.col("owners") == 1, F.lit(1).cast("long")).otherwise(F.col("owners") + F.col("r")).alias("calls"))


# --- layout ----------------------------------------------------------------------------------------------------


# one step places a tail or, where none fits, opens a page; lft holds how many tails of each size (from 1) are left
_SIZES = f"SELECT list_id, n // {VPP} AS f, n % {VPP} AS tail, CAST(coalesce(sum(n // {VPP}) OVER (ORDER BY list_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, row_number() OVER (PARTITION BY n % {VPP} ORDER BY list_id) - 1 AS nth FROM (SELECT list_id, count(*) AS n FROM prim GROUP BY list_id)"
_COUNTS = f"SELECT list(k ORDER BY z) AS c FROM (SELECT z, count(list_id) AS k FROM (SELECT unnest(range(1, {VPP})) AS z) LEFT JOIN s ON s.tail = z GROUP BY z)"
_PACKED = (
    f"SELECT CAST(0 AS BIGINT) AS page, CAST({VPP} AS BIGINT) AS room, c AS lft, CAST(NULL AS BIGINT) AS size, CAST(NULL AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS slot FROM counts UNION ALL "
    f"SELECT page + CASE WHEN z IS NULL THEN 1 ELSE 0 END, CASE WHEN z IS NULL THEN {VPP} ELSE room - z END, list_transform(lft, lambda x, i: CASE WHEN i = z THEN x - 1 ELSE x END), z, c[z] - lft[z], {VPP} - room "
    f"FROM (SELECT *, list_max(list_filter(range(1, {VPP}), lambda k: k <= room AND lft[k] > 0)) AS z FROM packed, counts WHERE list_sum(lft) > 0)"
)
_LAID = (
    f"SELECT vec_id, page, slot, page * {VPP} + slot AS loc FROM (SELECT p.vec_id, CASE WHEN p.pos < s.f * {VPP} THEN s.start + p.pos // {VPP} ELSE k.page + (SELECT CAST(sum(f) AS BIGINT) FROM s) END AS page, CASE WHEN p.pos < s.f * {VPP} THEN p.pos % {VPP} ELSE k.slot + p.pos - s.f * {VPP} END AS slot "
    "FROM (SELECT vec_id, list_id, row_number() OVER (PARTITION BY list_id ORDER BY vec_id) - 1 AS pos FROM prim) p JOIN s USING (list_id) LEFT JOIN packed k ON k.size = s.tail AND k.nth = s.nth)"
)


@query("B22_bucket_layout", sql(_LAID, "prim", s=_SIZES, counts=_COUNTS, packed=_PACKED).replace("WITH ", "WITH RECURSIVE ", 1))
def bucket_layout(spark, sf):
    return I.bucket_layout(primary(spark, sf), VPP)


@query("B22_full_pages", sql(f"SELECT vec_id, start + pos // {VPP} AS page, pos % {VPP} AS slot FROM (SELECT p.vec_id, row_number() OVER (PARTITION BY p.list_id ORDER BY vec_id) - 1 AS pos, s.f, s.start FROM prim p JOIN (SELECT list_id, n // {VPP} AS f, CAST(coalesce(sum(n // {VPP}) OVER (ORDER BY list_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT list_id, count(*) AS n FROM prim GROUP BY list_id)) s USING (list_id)) WHERE pos < f * {VPP}", "prim"))
def full_pages(spark, sf):
    n = primary(spark, sf).groupBy("list_id").agg(F.expr(f"count(*) div {VPP}").alias("full")).agg(F.coalesce(F.sum("full"), F.lit(0)).alias("pages"))
    return bucket_layout(spark, sf).join(F.broadcast(n)).where("page < pages").select("vec_id", "page", "slot")


@query("B24_sequential_layout", sql("SELECT * FROM seqlay", "seqlay"))
def seq_layout(spark, sf):
    return I.sequential_layout(Tables(spark, sf).v, VPP)


@query("B25_layout_stats", sql(f"SELECT count(*) AS vectors, CAST(sum(n // {VPP}) AS BIGINT) AS full_pages, count(*) FILTER (WHERE n % {VPP} > 0) AS tails FROM (SELECT list_id, count(*) AS n FROM prim GROUP BY list_id)".replace("count(*) AS vectors", "CAST(sum(n) AS BIGINT) AS vectors"), "prim"))
def layout_stats(spark, sf):
    n = primary(spark, sf).groupBy("list_id").agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("vectors"), F.sum(F.expr(f"n div {VPP}")).alias("full_pages"), F.count_if(F.col("n") % VPP > 0).alias("tails"))


# --- several owners --------------------------------------------------------------------------------------------


@query("B28_list_partitions", sql("SELECT list_id, part FROM lp", "lp"))
def list_partitions(spark, sf):
    return Tables(spark, sf).lp()


@query("B29_overlap", sql("SELECT CAST(sum(n) AS BIGINT) AS summed, any_value(total) AS total FROM (SELECT part, count(DISTINCT vec_id) AS n FROM post JOIN lp USING (list_id) GROUP BY part), (SELECT count(DISTINCT vec_id) AS total FROM post)", "post", "lp"))
def overlap(spark, sf):
    t = Tables(spark, sf)
    pv = t.post().join(t.lp(), "list_id").select("part", "vec_id").distinct()
    return pv.agg(F.count("*").alias("summed"), F.countDistinct("vec_id").alias("total"))


@query("J6_group_by_owner", sql("SELECT qid, node, list(list_id ORDER BY pos) AS lists FROM own GROUP BY qid, node", "own"))
def group_by_owner(spark, sf):
    return D.owner_groups(Built(spark, sf).own())


@query("J7_split_by_origin", sql("SELECT qid, node, list(vec_id ORDER BY adc, vec_id) AS ids FROM merged GROUP BY qid, node", "merged"))
def split_by_origin(spark, sf):
    t = Built(spark, sf)
    first = D.owner_filter(t.own(), t.post(), t.codes(), t.luts(), P.n)
    m = D.merge_origin(first, P.n)
    return m.groupBy("qid", "node").agg(F.transform(F.sort_array(F.collect_list(F.struct("adc", "vec_id"))), lambda x: x["vec_id"]).alias("ids"))


@query("J8_split_by_hash", sql("SELECT qid, vec_id, CAST(o[CAST(((vec_id * 2654435761) % 4294967296) // 65536 % len(o) AS INTEGER) + 1] AS INTEGER) AS node FROM (SELECT m.qid, m.vec_id, list_sort(list(f.node)) AS o FROM merged m JOIN ofilt f ON f.qid = m.qid AND f.vec_id = m.vec_id GROUP BY m.qid, m.vec_id)", "merged", "ofilt"))
def split_by_hash(spark, sf):
    t = Built(spark, sf)
    first = D.owner_filter(t.own(), t.post(), t.codes(), t.luts(), P.n)
    return D.split_by_hash(first, P.n)


@query("A2_merge_topk", sql("SELECT qid, vec_id, adc, CAST(r AS INTEGER) AS rank FROM merged", "merged"))
def merge_topk(spark, sf):
    t = Built(spark, sf)
    return D.merge_topk(D.owner_filter(t.own(), t.post(), t.codes(), t.luts(), P.n), "adc", P.n)


@query("R7_two_phase", sql("SELECT qid, rank, vec_id, dist FROM ans", "ans"))
def two_phase(spark, sf):
    t = Built(spark, sf)
    return D.two_phase(t.own(), t.post(), t.codes(), t.luts(), t.v, t.q, P)


@query("R9_local", sql(f"SELECT qid, CAST(r AS INTEGER) AS rank, vec_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS r FROM (SELECT f.qid, f.vec_id, min({l2('qv', 'v')}) AS dist FROM ofilt f JOIN q USING (qid) JOIN v USING (vec_id) GROUP BY f.qid, f.vec_id)) WHERE r <= 10", "ofilt", "q", "v"))
def local(spark, sf):
    t = Built(spark, sf)
    first = D.owner_filter(t.own(), t.post(), t.codes(), t.luts(), P.n)
    return D.local_rerank(first, t.v, t.q, P.k)


@query("P16_quota", sql("SELECT qid, node, n AS scored, CAST(ceil(50.0 * n / sum(n) OVER (PARTITION BY qid)) AS BIGINT) AS quota FROM (SELECT qid, node, count(*) AS n FROM ocand GROUP BY qid, node)", "ocand"))
def quota(spark, sf):
    t = Built(spark, sf)
    return D.quotas(t.own(), t.post(), P.n)


@query("R10_local_quota", sql(f"SELECT qid, CAST(r AS INTEGER) AS rank, vec_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS r FROM (SELECT f.qid, f.vec_id, min({l2('qv', 'v')}) AS dist FROM ofilt f JOIN qt USING (qid, node) JOIN q ON q.qid = f.qid JOIN v ON v.vec_id = f.vec_id WHERE f.r <= quota GROUP BY f.qid, f.vec_id)) WHERE r <= 10", "ofilt", "ocand", "q", "v", qt="SELECT qid, node, CAST(ceil(50.0 * n / sum(n) OVER (PARTITION BY qid)) AS BIGINT) AS quota FROM (SELECT qid, node, count(*) AS n FROM ocand GROUP BY qid, node)"))
def local_quota(spark, sf):
    t = Built(spark, sf)
    first = D.owner_filter(t.own(), t.post(), t.codes(), t.luts(), P.n, quota=True)
    return D.local_rerank(first, t.v, t.q, P.k)


@query("A16_fan_out", sql("SELECT round(avg(n), 6) AS owners, round(avg(CAST(n = 1 AS INTEGER)), 6) AS one, round(avg(CAST(n <= 2 AS INTEGER)), 6) AS two, round(avg(n / 3.0), 6) AS entry_is_owner FROM (SELECT qid, count(DISTINCT node) AS n FROM own GROUP BY qid)", "own"))
def fan_out(spark, sf):
    return D.fan_out(Built(spark, sf).own(), NODES)


CTE |= {
    "scof": "SELECT qid, node, count(*) AS scored FROM ocand GROUP BY qid, node",
    "work": "SELECT g.qid, g.node, coalesce(s.scored, 0) AS scored, coalesce(r.ids, 0) AS ids, coalesce(r.pages, 0) AS pages FROM (SELECT DISTINCT qid, node FROM own) g LEFT JOIN scof s USING (qid, node) LEFT JOIN (SELECT qid, node, count(*) AS ids, count(DISTINCT page) AS pages FROM merged JOIN seqlay USING (vec_id) GROUP BY qid, node) r USING (qid, node)",
}
NEEDS |= {"scof": ["ocand"], "work": ["own", "scof", "merged", "seqlay"]}


@query("A18_hot_owner", sql("SELECT round(max((s * 3 / sum_s + p * 3 / sum_p + c * 3 / sum_c) / 3), 6) AS hot FROM (SELECT *, sum(s) OVER () AS sum_s, sum(p) OVER () AS sum_p, sum(c) OVER () AS sum_c FROM (SELECT node, CAST(sum(scored) AS DOUBLE) AS s, CAST(sum(pages) AS DOUBLE) AS p, CAST(count(*) + count(*) FILTER (WHERE ids > 0) AS DOUBLE) AS c FROM work GROUP BY node))", "work"))
def hot_owner(spark, sf):
    t = Built(spark, sf)
    return D.hot_owner(t.own(), t.post(), t.codes(), t.luts(), I.sequential_layout(t.v, VPP), P.n, NODES)


# sizes that divide the partitions or not: the first parts % size nodes have one partition more
_SIZED = "SELECT n AS nodes, nav.qid, list_id, CASE WHEN part < (8 % n) * (8 // n + 1) THEN part // (8 // n + 1) ELSE 8 % n + (part - (8 % n) * (8 // n + 1)) // greatest(8 // n, 1) END AS node FROM nav JOIN lp USING (list_id), (SELECT unnest([1, 2, 3, 8]) AS n)"
_OVER = {
    "sized": _SIZED,
    "zc": "SELECT DISTINCT nodes, qid, node, vec_id FROM sized JOIN post USING (list_id)",
    "zf": "SELECT * FROM (SELECT zc.*, adc, row_number() OVER (PARTITION BY nodes, qid, node ORDER BY adc, vec_id) AS r FROM zc JOIN scored USING (qid, vec_id)) WHERE r <= 50",
    "zm": "SELECT * FROM (SELECT nodes, qid, vec_id, min(node) AS node, row_number() OVER (PARTITION BY nodes, qid ORDER BY min(adc), vec_id) AS r FROM zf GROUP BY nodes, qid, vec_id) WHERE r <= 50",
    "zw": "SELECT g.nodes, g.qid, g.node, coalesce(s.scored, 0) AS scored, coalesce(r.ids, 0) AS ids, coalesce(r.pages, 0) AS pages FROM (SELECT DISTINCT nodes, qid, node FROM sized) g LEFT JOIN (SELECT nodes, qid, node, count(*) AS scored FROM zc GROUP BY ALL) s USING (nodes, qid, node) LEFT JOIN (SELECT nodes, qid, node, count(*) AS ids, count(DISTINCT page) AS pages FROM zm JOIN seqlay USING (vec_id) GROUP BY ALL) r USING (nodes, qid, node)",
    "zs": "SELECT nodes, count(DISTINCT qid) AS q, count(*) AS f, count(*) FILTER (WHERE ids > 0) AS r, CAST(sum(scored) AS BIGINT) AS scored, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(least(50, scored)) AS BIGINT) AS merge_in FROM zw GROUP BY nodes",
    "zu": "SELECT *, 88.5::DOUBLE * f + 0.093::DOUBLE * scored + 137.1::DOUBLE * r + 6.2::DOUBLE * pages + 59.4::DOUBLE * q + 0.177::DOUBLE * (merge_in + r * 10) AS us FROM zs",
    "zh": "SELECT nodes, round(max((s * nodes / ss + p * nodes / sp + c * nodes / sc) / 3), 6) AS hot FROM (SELECT *, sum(s) OVER (PARTITION BY nodes) AS ss, sum(p) OVER (PARTITION BY nodes) AS sp, sum(c) OVER (PARTITION BY nodes) AS sc FROM (SELECT nodes, node, CAST(sum(scored) AS DOUBLE) AS s, CAST(sum(pages) AS DOUBLE) AS p, CAST(count(*) + count(*) FILTER (WHERE ids > 0) AS DOUBLE) AS c FROM zw GROUP BY nodes, node)) GROUP BY nodes",
    "zp": f"SELECT * FROM (SELECT zm.nodes, zm.qid, zm.node, zm.vec_id, {l2('qv', 'v')} AS dist, row_number() OVER (PARTITION BY nodes, zm.qid, node ORDER BY {l2('qv', 'v')}, zm.vec_id) AS r FROM zm JOIN q USING (qid) JOIN v USING (vec_id)) WHERE r <= 10",
    "za": "SELECT nodes, qid, list(vec_id ORDER BY e) AS ids FROM (SELECT nodes, qid, vec_id, row_number() OVER (PARTITION BY nodes, qid ORDER BY dist, vec_id) AS e FROM zp) WHERE e <= 10 GROUP BY nodes, qid",
    "zx": "SELECT a.nodes, count(*) FILTER (WHERE a.ids <> b.ids) AS mismatches FROM za a JOIN za b ON a.qid = b.qid AND b.nodes = 1 GROUP BY a.nodes",
}


@query("A17_overhead", sql("""SELECT CAST(z.nodes AS INTEGER) AS nodes, round(z.f / z.q, 6) AS owners_f, round(z.r / z.q, 6) AS owners_r, round(z.scored / z.q, 6) AS scored, round(z.scored / o.scored, 6) AS scored_x1, round(z.pages / z.q, 6) AS pages, round(z.pages / o.pages, 6) AS pages_x1,
round(z.merge_in / z.q, 6) AS merge_in, round(z.us / o.us, 6) AS work_x1, round(z.nodes * o.us / z.us, 6) AS speedup, hot, mismatches FROM zu z JOIN zu o ON o.nodes = 1 JOIN zh ON zh.nodes = z.nodes JOIN zx ON zx.nodes = z.nodes""", "nav", "lp", "post", "scored", "seqlay", "q", "v", **_OVER))
def overhead(spark, sf):
    t = Built(spark, sf)
    return D.overhead(t.nav(), t.lp(), t, I.sequential_layout(t.v, VPP), [1, 2, 3, 8], PARTS, P)


_COST = {
    "grp": "SELECT qid, node, scored, ceil(50.0 * scored / sum(scored) OVER (PARTITION BY qid)) AS quota FROM work",
    "picked": "SELECT strategy, qid, node, vec_id FROM merged, (SELECT unnest(['two-phase', 'two-phase+1']) AS strategy) UNION ALL SELECT 'local', qid, node, vec_id FROM ofilt UNION ALL SELECT 'local-quota', f.qid, f.node, f.vec_id FROM ofilt f JOIN grp USING (qid, node) WHERE f.r <= quota",
    "every": "SELECT x.strategy, g.qid, g.node, g.scored, coalesce(r.ids, 0) AS ids, coalesce(r.pages, 0) AS pages FROM grp g CROSS JOIN (SELECT unnest(['two-phase', 'two-phase+1', 'local', 'local-quota']) AS strategy) x LEFT JOIN (SELECT strategy, qid, node, count(*) AS ids, count(DISTINCT page) AS pages FROM picked JOIN seqlay USING (vec_id) GROUP BY ALL) r ON r.strategy = x.strategy AND r.qid = g.qid AND r.node = g.node",
    "tot": """SELECT qid, strategy, count(*) AS owners, count(*) FILTER (WHERE ids > 0) AS answered, CAST(sum(scored) AS BIGINT) AS scored, CAST(sum(least(50, scored)) AS BIGINT) AS returned, CAST(sum(ids) AS BIGINT) AS reranked, CAST(sum(pages) AS BIGINT) AS pages,
  max(88.5::DOUBLE + 0.093::DOUBLE * scored) AS slow_f, coalesce(max(137.1::DOUBLE + 6.2::DOUBLE * pages) FILTER (WHERE ids > 0), 0) AS slow_r, max(88.5::DOUBLE + 0.093::DOUBLE * scored + CASE WHEN ids > 0 THEN 70.6::DOUBLE + 6.2::DOUBLE * pages ELSE 0 END) AS slow,
  strategy LIKE 'local%' OR (strategy = 'two-phase+1' AND count(*) = 1) AS fused FROM every GROUP BY qid, strategy""",
}


@query("A19_cost_model", sql("""SELECT qid, strategy, owners + CASE WHEN fused THEN 0 ELSE answered END AS calls, reranked, pages,
round(88.5::DOUBLE * owners + 0.093::DOUBLE * scored + 70.6::DOUBLE * answered + 6.2::DOUBLE * pages + 29.7::DOUBLE + 0.177::DOUBLE * answered * 10 + CASE WHEN fused THEN 0 ELSE 66.5::DOUBLE * answered + 29.7::DOUBLE + 0.177::DOUBLE * returned END, 4) AS work,
round(29.7::DOUBLE + 0.177::DOUBLE * answered * 10 + CASE WHEN fused THEN slow ELSE slow_f + slow_r + 29.7::DOUBLE + 0.177::DOUBLE * returned END, 4) AS latency FROM tot""", "work", "merged", "ofilt", "seqlay", **_COST))
def cost_model(spark, sf):
    t = Built(spark, sf)
    return D.strategy_costs(t.own(), t.post(), t.codes(), t.luts(), I.sequential_layout(t.v, VPP), P)


@query("A20_overlap_at_k", sql("SELECT g.qid, count(a.vec_id) AS shared FROM gt g LEFT JOIN ans a ON a.qid = g.qid AND a.vec_id = g.vec_id GROUP BY g.qid", "gt", "ans"))
def overlap_at_k(spark, sf):
    a, b = exact_knn(spark, sf), search(spark, sf)
    return a.join(b.select("qid", "vec_id", F.lit(1).alias("x")), ["qid", "vec_id"], "left").groupBy("qid").agg(F.count("x").alias("shared"))


@query("R11_selector", sql("SELECT qid, CAST(CASE WHEN bool_or(node = 1) THEN 1 WHEN count(DISTINCT node) = 1 THEN min(node) ELSE 1 END AS INTEGER) AS owner, CAST(([0, 2])[row_number() OVER (ORDER BY qid) % 2 + 1] AS INTEGER) AS warmup, 1 AS local FROM own GROUP BY qid", "own"))
def selector(spark, sf):
    """Who merges the answers of queries that come in at node 1, by the three selectors; nodes 0 and 2 are no entries."""
    own = Built(spark, sf).own()
    pick = lambda df, name: df.withColumnRenamed("owner", name)
    return pick(D.pick_owner(own, 1), "owner").join(pick(D.pick_warmup(own, [0, 1, 2], [1]), "warmup"), "qid").join(pick(D.pick_entry(own, 1), "local"), "qid")
