"""Registered queries of files, index folders and trained builds: what was written is read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.folders import shared
from spindrift.operators import graph, train
from spindrift.operators import index as I
from spindrift.operators.blocks import nearest
from spindrift.plans.declare import query
from spindrift.plans.vector_queries import PARTS, VPP, Tables, folder, l2, sql
from spindrift.sources import pages, vecfiles
from spindrift.sources.index_dir import AnnIndex

def _embeddings(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")


def _local(path: str) -> str:
    return path.removeprefix("file://")


_INTS = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"
_PLACE = "CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT)"


def _quantised(df):
    return df.select("vec_id", I.V.quantised(F.col("embedding")).alias("v"))


@query("S1_read_prefix", f"SELECT {_PLACE} AS vec_id, {_INTS} AS v FROM embeddings ORDER BY vec_id LIMIT 100")
def read_prefix(spark, sf):
    """The first 100 rows of a binary file of the embeddings."""
    path = _local(shared(spark, "vectors")) + ".fbin"
    vecfiles.save_bin(_embeddings(spark, sf), path, part_rows=64)
    return _quantised(vecfiles.read_vectors(spark, path, max_n=100))


@query("S2_read_vecs", f"SELECT {_PLACE} AS vec_id, {_INTS} AS v FROM embeddings")
def read_vecs(spark, sf):
    path = _local(shared(spark, "vectors")) + ".fvecs"
    vecfiles.save_bin(_embeddings(spark, sf), path)
    return _quantised(vecfiles.read_vectors(spark, path))


@query("S4_write_bytes", f"SELECT {_PLACE} AS vec_id, list_transform(embedding, lambda x: CAST(floor(abs(100 * CAST(x AS DOUBLE))) AS BIGINT)) AS v FROM embeddings")
def write_bytes(spark, sf):
    path = _local(shared(spark, "vectors")) + ".u8bin"
    scaled = _embeddings(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: F.floor(F.abs(F.lit(100.0) * x.cast("double"))).cast("float")))
    vecfiles.save_bin(scaled, path, part_rows=64)  # many parts, read as one file
    return vecfiles.read_vectors(spark, path).select("vec_id", F.transform("embedding", lambda x: x.cast("long")).alias("v"))


@query("S3_cached", f"SELECT vec_id, {_INTS} AS v FROM embeddings")
def cached(spark, sf):
    return I.read_vectors(spark, sf).cache()


@query("S8_from_rows", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings WHERE vec_id < 50")
def from_rows(spark, sf):
    """A table made from an Arrow table in memory."""
    t = _embeddings(spark, sf).where("vec_id < 50").toArrow()
    return spark.createDataFrame(t).select("vec_id", F.size("embedding").alias("dims"))


@query("S6_truth_file", sql("SELECT CAST(dense_rank() OVER (ORDER BY qid) - 1 AS BIGINT) AS qid, rank, vec_id, CAST(dist AS DOUBLE) AS dist FROM gt", "gt"))
def truth_file(spark, sf):
    """Exact neighbours as a ground-truth file, read back in long form."""
    t = Tables(spark, sf)
    path = _local(shared(spark, "truth")) + ".ibin"
    vecfiles.save_truth(I.exact_knn(t.q, t.v, 10), path, part_rows=4)
    return vecfiles.read_truth(spark, path)


@query("S5_truth_recall", sql("SELECT CAST(dense_rank() OVER (ORDER BY qid) - 1 AS BIGINT) AS qid, count(*) AS ids, CAST(sum(vec_id) AS BIGINT) AS total FROM gt GROUP BY qid", "gt"))
def truth_ids(spark, sf):
    return truth_file(spark, sf).groupBy("qid").agg(F.count("*").alias("ids"), F.sum("vec_id").alias("total"))


@query("S17_chosen_pages", sql("SELECT v.vec_id, page, slot, v.v FROM seqlay JOIN v USING (vec_id) WHERE page IN (0, 3, 4, 9) OR loc BETWEEN 100 AND 131", "seqlay", "v"))
def chosen_pages(spark, sf):
    """Pages and locations asked for, read from a page file by their byte ranges alone."""
    e = _embeddings(spark, sf)
    layout = I.sequential_layout(I.read_vectors(spark, sf), VPP)
    path = _local(shared(spark, "pages")) + ".pages"
    pages.save_pages(e, layout, path, VPP)
    some = pages.read_pages(spark, path, "page in (0, 3, 4, 9)").unionByName(pages.read_pages(spark, path, "loc >= 100 and loc <= 131 and page not in (0, 3, 4, 9)"))
    return layout.select("vec_id", "loc", F.col("slot").cast("long").alias("slot")).join(some.drop("slot"), "loc").select("vec_id", "page", "slot", I.V.quantised(F.col("embedding")).alias("v"))


@query("S9_index_meta", f"SELECT count(*) AS vectors, CAST(8 AS BIGINT) AS m, CAST({PARTS} AS BIGINT) AS parts, CAST({VPP} AS BIGINT) AS vpp FROM embeddings WHERE embedding IS NOT NULL")
def index_meta(spark, sf):
    m = folder(spark, sf).meta()
    return spark.createDataFrame([(m["vectors"], m["m"], m["parts"], m["vpp"])], "vectors long, m long, parts long, vpp long")


@query("S10_index_codes", sql("SELECT vec_id, list(code ORDER BY sub) AS code FROM codes1 GROUP BY vec_id", "codes1"))
def index_codes(spark, sf):
    return folder(spark, sf).read("codes").select("vec_id", "code")


@query("S11_index_codebook", sql("SELECT sub, code, c FROM cb", "cb"))
def index_codebook(spark, sf):
    return folder(spark, sf).read("codebook").select("sub", "code", "c")


@query("S12_index_postings", sql("SELECT vec_id, list_id, rank, dist FROM post", "post"))
def index_postings(spark, sf):
    return folder(spark, sf).read("postings").select("vec_id", "list_id", "rank", "dist")


@query("S13_index_heads", sql("SELECT list_id, head_vec_id, hv FROM h", "h"))
def index_heads(spark, sf):
    return folder(spark, sf).read("heads").select("list_id", "head_vec_id", "hv")


@query("S14_segments", sql("SELECT part, count(*) AS postings, count(DISTINCT list_id) AS lists FROM post JOIN lp USING (list_id) WHERE part IN (1, 3, 4) GROUP BY part", "post", "lp"))
def segments(spark, sf):
    """Three partitions' files, read with their checksums verified."""
    return folder(spark, sf).segments([1, 3, 4]).groupBy("part").agg(F.count("*").alias("postings"), F.countDistinct("list_id").alias("lists"))


@query("S15_index_partitions", sql("SELECT list_id, part FROM lp", "lp"))
def index_partitions(spark, sf):
    return folder(spark, sf).read("list_part").select("list_id", "part")


@query("S16_describe", sql("SELECT 'heads' AS name, count(*) AS rows FROM h UNION ALL SELECT 'postings', count(*) FROM post UNION ALL SELECT 'codebook', count(*) FROM cb UNION ALL SELECT 'codes', count(*) FROM v UNION ALL SELECT 'layout', count(*) FROM v UNION ALL SELECT 'list_part', count(*) FROM lp", "h", "post", "cb", "lp"))
def describe(spark, sf):
    return folder(spark, sf).describe()


@query("B27_validated", "SELECT CAST(0 AS BIGINT) AS violations, count(*) AS vectors FROM embeddings WHERE embedding IS NOT NULL")
def validated(spark, sf):
    d = folder(spark, sf)
    return spark.createDataFrame([(sum(d.validate().values()), d.meta()["vectors"])], "violations long, vectors long")


@query("U_engine_search", sql("SELECT qid, rank, vec_id, dist FROM ans", "ans"))
def engine_search(spark, sf):
    """Search over the folder, as the client's API has it."""
    t = Tables(spark, sf)
    return AnnIndex(folder(spark, sf), t.v).search(t.q)


COARSE = 3


@query("B12_coarse_navigation", sql(f"""SELECT vec_id, list_id, rank, dist FROM (
  SELECT vec_id, list_id, dist, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY dist, list_id) AS INTEGER) AS rank, min(dist) OVER (PARTITION BY vec_id) AS d1 FROM met)
WHERE rank <= 8 AND dist * 10000 <= d1 * 12100""", "v", "h",
    cells="SELECT list_id // 10 AS cell, hv AS c FROM h WHERE list_id % 10 = 0",
    lies=f"SELECT list_id, cell FROM (SELECT list_id, cell, row_number() OVER (PARTITION BY list_id ORDER BY {l2('hv', 'c')}, cell) AS r FROM h, cells) WHERE r = 1",
    asks=f"SELECT vec_id, cell FROM (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY {l2('v', 'c')}, cell) AS r FROM v, cells) WHERE r <= {COARSE}",
    met=f"SELECT vec_id, list_id, {l2('v', 'hv')} AS dist FROM asks JOIN lies USING (cell) JOIN v USING (vec_id) JOIN h USING (list_id)"))
def coarse_navigation(spark, sf):
    """Assignment through cells of heads: a vector meets the heads of its three nearest cells and no others."""
    t = Tables(spark, sf)
    cells = t.h.where("list_id % 10 = 0").select(F.expr("cast(list_id div 10 as int)").alias("id"), F.col("hv").alias("v"))
    return I.assign_coarse(t.v, t.h, cells, COARSE, I.Params())


def _graph(t):
    return graph.build(t.h.select(F.col("list_id").alias("id"), F.col("hv").alias("v")))


@query("B12_proximity_graph")
def proximity_graph(spark, sf):
    """Edges between heads, from neighbours of neighbours; how many of the exact ones they hold is tested."""
    return _graph(Tables(spark, sf))[0].select(F.col("id").alias("list_id"), F.col("to").alias("to_list"), "dist")


@query("J2_graph_navigate")
def graph_navigate(spark, sf):
    """The nearest lists by the proximity graph: per query how many heads were met, of how many, and the share of the exact answer found."""
    t = Tables(spark, sf)
    near, seen = I.navigate_graph(t.q, t.h, _graph(t), 8, beam=10)
    found = t.nav().select("qid", "list_id").join(near.select("qid", "list_id", F.lit(1).alias("hit")), ["qid", "list_id"], "left")
    recall = found.groupBy("qid").agg(F.count("hit").alias("found"), (F.count("hit") / F.count("*")).alias("recall"))
    return recall.join(seen, "qid").withColumn("heads", F.lit(t.h.count()))


@query("B7_balanced_leaves", "SELECT vec_id, CAST(1 AS BIGINT) AS leaves, true AS bounded FROM embeddings WHERE embedding IS NOT NULL")
def balanced_leaves(spark, sf):
    """A trained hierarchy, split by joins down to nodes of 100 vectors: every vector is in one leaf, none of more than slack / ratio members."""
    c = train.cluster(I.read_vectors(spark, sf), ratio=0.1, slack=1.5, task=100)
    n = c.groupBy("node", "leaf").agg(F.count("*").alias("n"))
    return c.join(n, ["node", "leaf"]).groupBy("vec_id").agg(F.count("*").alias("leaves"), (F.max("n") <= 15).alias("bounded"))


def _label(centres):
    return f"SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY {l2('v', 'c')}, label) AS r FROM v, {centres}) WHERE r = 1"


@query("B7_first_level", sql("SELECT vec_id, label FROM l1", "v",
    k="SELECT least(greatest(floor(count(*) / 10 + 0.5), 2), 32) AS k FROM v",
    c0="SELECT CAST(r - 1 AS INTEGER) AS label, v AS c FROM (SELECT v, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS r FROM v), k WHERE r <= k",
    l0=_label("c0"),
    c1="""SELECT label, list(x ORDER BY dim) AS c FROM (SELECT label, dim, CAST(floor((2 * sum(v[dim + 1]) + count(*)) / (2 * count(*))) AS BIGINT) AS x
      FROM l0 JOIN v USING (vec_id), (SELECT unnest(range(64)) AS dim) GROUP BY label, dim) GROUP BY label""",
    l1=_label("c1")))
def first_level(spark, sf):
    """The first level of the hierarchy with one Lloyd step."""
    rows = I.read_vectors(spark, sf).select(F.lit(1).cast("long").alias("node"), "vec_id", "v")
    return train.split_level(rows, 10, iterations=1).select("vec_id", "label")


@query("B2_seeding_round", sql("""SELECT vec_id, dist FROM d, t WHERE CAST(CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR) || ':42'), 1, 8) AS BIGINT) AS HUGEINT) * total < CAST(dist AS HUGEINT) * 64 * 4294967296""", "v",
    c="SELECT v AS c FROM v ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT 1",
    d=f"SELECT vec_id, {l2('v', 'c')} AS dist FROM v, c",
    t="SELECT CAST(sum(dist) AS HUGEINT) AS total FROM d"))
def seeding_round(spark, sf):
    """One round of oversampled seeding from one centre: some 64 vectors, drawn by squared distance."""
    v = I.read_vectors(spark, sf)
    first = v.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(1).select(F.col("vec_id").alias("id"), "v")
    return train.seeding_round(v, first, 64, 42).select("vec_id", "dist")


@query("B5_repair", sql("""SELECT id, c AS v FROM cen WHERE id NOT IN (SELECT id FROM moved) UNION ALL SELECT id, list_transform(c, lambda x: CAST(floor(x * m / 1024) AS BIGINT)) FROM moved""", "v", "h",
    cen="SELECT list_id AS id, hv AS c FROM h UNION ALL SELECT list_id + 1000000, hv FROM h WHERE list_id % 5 = 0",
    sz=f"SELECT id, count(*) AS n FROM (SELECT id, row_number() OVER (PARTITION BY vec_id ORDER BY {l2('v', 'c')}, id) AS r FROM v, cen) WHERE r = 1 GROUP BY id",
    e="SELECT id, row_number() OVER (ORDER BY id) AS r FROM cen WHERE id NOT IN (SELECT id FROM sz)",
    b="SELECT id, c, row_number() OVER (ORDER BY n DESC, id) AS r FROM cen JOIN sz USING (id) WHERE n > 1",
    moved="SELECT e.id, c, 1025 AS m FROM e JOIN b USING (r) UNION ALL SELECT b.id, c, 1023 FROM e JOIN b USING (r)"))
def repair(spark, sf):
    """Heads and copies of some of them, which have no members as ties go to the smaller id: each copy takes half of a large cluster."""
    t = Tables(spark, sf)
    c = t.h.select(F.col("list_id").alias("id"), F.col("hv").alias("v"))
    c = c.unionByName(c.where("id % 5 = 0").withColumn("id", F.col("id") + 1_000_000))
    sizes = nearest(t.v.select(F.col("vec_id").alias("id"), "v"), c, 1).groupBy("id").agg(F.count("*").alias("n"))
    return train.repaired(c, sizes)


@query("B9_chunks", f"SELECT vec_id, CAST((row_number() OVER (ORDER BY vec_id) - 1) // 16 AS INTEGER) AS chunk FROM embeddings WHERE embedding IS NOT NULL")
def chunks(spark, sf):
    return train.chunked(I.read_vectors(spark, sf), 16).select("vec_id", "chunk")


_SUB = "(SELECT CAST(unnest(range(8)) AS INTEGER) AS dim) d"


def _sums(codes):
    return f"SELECT c.sub, c.code, d.dim, CAST(sum(v.v[c.sub * 8 + d.dim + 1]) AS BIGINT) AS total, count(*) AS members FROM {codes} c JOIN v USING (vec_id), {_SUB} GROUP BY c.sub, c.code, d.dim"


def _book(old, codes):
    return f"""SELECT o.sub, o.code, coalesce(n.c, o.c) AS c FROM {old} o LEFT JOIN (SELECT sub, code, list(x ORDER BY dim) AS c FROM (
      SELECT sub, code, dim, CAST(floor((2 * total + members) / (2 * members)) AS BIGINT) AS x FROM ({_sums(codes)})) GROUP BY sub, code) n USING (sub, code)"""


def _codes(book):
    return f"SELECT vec_id, sub, code, dist FROM (SELECT vec_id, b.sub, b.code, {l2('v[b.sub * 8 + 1 : b.sub * 8 + 8]', 'c')} AS dist, row_number() OVER (PARTITION BY vec_id, b.sub ORDER BY dist, b.code) AS r FROM v, {book} b) WHERE r = 1"


_STEPS = {"cb1": _book("cb", "codes1"), "codes2": _codes("cb1"), "cb2": _book("cb1", "codes2")}


@query("B18_codebook_sums", sql(_sums("codes1"), "codes1", "v"))
def codebook_sums(spark, sf):
    """One step of training a product quantizer: sums and members of all codewords of all sub-spaces."""
    t = Tables(spark, sf)
    return train.codebook_sums(t.v, t.cb(), 8)


@query("B18_trained_codebook", sql("SELECT sub, code, c FROM cb2", "codes1", "v", **_STEPS))
def trained_codebook(spark, sf):
    """The recipe's codebook after two steps over all vectors."""
    t = Tables(spark, sf)
    return train.train_codebook(t.v, 8, iterations=2, first=t.cb())


@query("B18_quantizer_error", sql("SELECT vec_id, CAST(sum(first) AS BIGINT) AS first, CAST(sum(dist) AS BIGINT) AS trained FROM codes3 JOIN f USING (vec_id, sub) GROUP BY vec_id", "codes1", "v",
    **_STEPS, codes3=_codes("cb2"), f=_codes("cb").replace("SELECT vec_id, sub, code, dist FROM", "SELECT vec_id, sub, dist AS first FROM", 1)))
def quantizer_error(spark, sf):
    """What quantizing each vector loses, before and after two steps."""
    t = Tables(spark, sf)
    first, trained = t.cb(), train.train_codebook(t.v, 8, iterations=2, first=t.cb())
    a, b = (train.quantizer_error(t.v, c, 8).withColumnRenamed("error", n) for c, n in ((first, "first"), (trained, "trained")))
    return a.join(b, "vec_id")


@query("R13_ordered_page", sql("SELECT qid, vec_id, dist FROM gt ORDER BY dist, qid, vec_id LIMIT 25", "gt"))
def ordered_page(spark, sf):
    t = Tables(spark, sf)
    return I.exact_knn(t.q, t.v, 10).orderBy("dist", "qid", "vec_id").limit(25).select("qid", "vec_id", "dist")


@query("P6_distinct_ids", sql("SELECT qid, vec_id FROM cand", "cand"))
def distinct_ids(spark, sf):
    return Tables(spark, sf).gathered().select("qid", "vec_id").distinct()
