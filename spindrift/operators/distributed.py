"""The search over several owners: lists belong to partitions, partitions to nodes; a node is a column.

The two-phase answer equals the single owner's for any placement: each owner's first n by asymmetric distance, merged
to the first n, exact distances where each id was reported (lowest owner), merged to the first k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.operators import index as I
from spindrift.operators.ranking import numbered


def range_partitions(heads: DataFrame, parts: int) -> DataFrame:
    """list_id, part: contiguous ranges of lists."""
    total = heads.agg((F.max("list_id") + 1).alias("total"))
    return heads.join(F.broadcast(total)).select("list_id", F.expr(f"cast(list_id * {parts} div total as int)").alias("part"))


def hash_partitions(heads: DataFrame, parts: int) -> DataFrame:
    return heads.select("list_id", F.pmod(F.xxhash64("list_id"), F.lit(parts)).cast("int").alias("part"))


def evenly_placed(parts: DataFrame, nodes: list[int]) -> DataFrame:
    """part, node of parts (part, numbered from 0): contiguous blocks in order of nodes, the first n % len(nodes) of them one larger."""
    base, rem = divmod(parts.count(), len(nodes))
    edge = rem * (base + 1)
    names = F.array(*[F.lit(n) for n in nodes])
    at = F.when(F.col("part") < edge, F.expr(f"part div {base + 1}")).otherwise(F.lit(rem) + F.expr(f"(part - {edge}) div {max(base, 1)}"))
    return parts.select("part", F.get(names, at.cast("int")).alias("node"))


def even_placement(spark: SparkSession, parts: int, nodes: list[int]) -> DataFrame:
    """part, node: evenly_placed() for so many partitions."""
    return evenly_placed(spark.range(parts).select(F.col("id").cast("int").alias("part")), nodes)


def group_by_owner(probed: DataFrame, list_part: DataFrame, placement: DataFrame) -> DataFrame:
    """qid, pos, list_id, node. list_part and placement have a row per list and partition; Spark broadcasts them if small."""
    return probed.select("qid", "pos", "list_id").join(list_part, "list_id").join(placement, "part").select("qid", "pos", "list_id", "node")


def owner_groups(owned: DataFrame) -> DataFrame:
    """qid, node, lists (closest first)."""
    g = owned.groupBy("qid", "node").agg(F.sort_array(F.collect_list(F.struct("pos", "list_id"))).alias("x"))
    return g.select("qid", "node", F.transform("x", lambda x: x["list_id"]).alias("lists"))


def owner_candidates(owned: DataFrame, postings: DataFrame) -> DataFrame:
    return owned.join(postings.select("list_id", "vec_id"), "list_id").select("qid", "node", "vec_id").distinct()


def quotas(owned: DataFrame, postings: DataFrame, n: int) -> DataFrame:
    """qid, node, scored, quota: an owner's share of n, rounded up."""
    c = owner_candidates(owned, postings).groupBy("qid", "node").agg(F.count("*").alias("scored"))
    share = F.ceil(F.lit(float(n)) * F.col("scored") / F.sum("scored").over(Window.partitionBy("qid")))
    return c.withColumn("quota", share.cast("long"))


def owner_filter(owned: DataFrame, postings: DataFrame, codes: DataFrame, luts: DataFrame, n: int, quota: bool = False) -> DataFrame:
    """qid, node, vec_id, adc, rank: each owner's first n, or first quota."""
    out = I.top(I.score(owner_candidates(owned, postings), codes, luts), "adc", n, ("qid", "node"))
    if quota:
        out = out.join(quotas(owned, postings, n), ["qid", "node"]).where(F.col("rank") <= F.col("quota")).drop("scored", "quota")
    return out


def merge_topk(parts: DataFrame, by: str, k: int) -> DataFrame:
    """One entry per id (its least distance), the first k by (distance, id); k < 0 keeps all."""
    one = parts.groupBy("qid", "vec_id").agg(F.min(by).alias(by))
    return I.top(one, by, k if k >= 0 else 1 << 30).select("qid", "vec_id", by, "rank")


def merge_origin(parts: DataFrame, n: int) -> DataFrame:
    """The merged first n with the lowest node that reported each: qid, node, vec_id, adc, rank."""
    one = parts.groupBy("qid", "vec_id").agg(F.min("adc").alias("adc"), F.min("node").alias("node"))
    return I.top(one, "adc", n)


def split_by_hash(parts: DataFrame, n: int) -> DataFrame:
    """As merge_origin, but a hash of the id picks among the nodes that reported it."""
    one = parts.groupBy("qid", "vec_id").agg(F.min("adc").alias("adc"), F.sort_array(F.collect_set("node")).alias("nodes"))
    pick = F.expr("cast((((vec_id * 2654435761L) % 4294967296L) div 65536) % size(nodes) as int)")
    return I.top(one, "adc", n).select("qid", "vec_id", F.get("nodes", pick).alias("node"))


def two_phase(owned: DataFrame, postings: DataFrame, codes: DataFrame, luts: DataFrame, vectors: DataFrame, queries: DataFrame, p: I.Params) -> DataFrame:
    """qid, rank, vec_id, dist."""
    first = merge_origin(owner_filter(owned, postings, codes, luts, p.n), p.n)
    per_owner = I.rerank(first.drop("rank"), vectors, queries, p.k, ("qid", "node"))
    return merge_topk(per_owner, "dist", p.k).select("qid", "rank", "vec_id", "dist")


def local_rerank(filtered: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Every owner re-ranks what passed its own filter; the answers merge."""
    per_owner = I.rerank(filtered, vectors, queries, k, ("qid", "node"))
    return merge_topk(per_owner, "dist", k).select("qid", "rank", "vec_id", "dist")


def pick_owner(owned: DataFrame, entry: int, aggregators: list[int] | None = None) -> DataFrame:
    """qid, owner: the entry if it owns a probed list; else a single owner of all of them that may aggregate; else the entry."""
    n = owned.groupBy("qid").agg(F.max(F.col("node") == entry).alias("mine"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    single = F.col("lo") == F.col("hi")
    if aggregators is not None:
        single &= F.col("lo").isin(aggregators)
    return n.select("qid", F.when(~F.col("mine") & single, F.col("lo")).otherwise(F.lit(entry)).alias("owner"))


def pick_entry(owned: DataFrame, entry: int) -> DataFrame:
    """qid, owner: the entry itself aggregates."""
    return owned.select("qid").distinct().withColumn("owner", F.lit(entry))


def pick_warmup(owned: DataFrame, aggregators: list[int], entries: list[int], entry: int | None = None) -> DataFrame:
    """qid, owner: nodes that aggregate and are no entries, in turn by order of query, from the second on; without any, the entry."""
    free = sorted(set(aggregators) - set(entries))
    if not free:
        return pick_entry(owned, min(entries) if entry is None else entry)
    asked = numbered(owned.select("qid").distinct(), [F.col("qid")], "__nth")
    return asked.select("qid", F.get(F.array(*[F.lit(n) for n in free]), (F.col("__nth") % len(free)).cast("int")).alias("owner"))


def fan_out(owned: DataFrame, nodes: int) -> DataFrame:
    n = owned.groupBy("qid").agg(F.countDistinct("node").alias("n"))
    share = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return n.agg(share("n", "owners"), share((F.col("n") == 1).cast("int"), "one"), share((F.col("n") <= 2).cast("int"), "two"), share(F.col("n") / F.lit(float(nodes)), "entry_is_owner"))


#: Queries whose candidates a task tells apart.
APART = 128
#: Microseconds: a remote call, a filter call, one scored candidate (fixed values of the cost model).
RPC, FILTER, SCORED = 66.5, 22.0, 0.093
#: A re-ranking call, one page read, a merge, one merged candidate (fixed values of the cost model).
RERANK, PAGE, MERGE, MERGED = 70.6, 6.2, 29.7, 0.177
COSTED = ["two-phase", "two-phase+1", "local", "local-quota"]


def _passed(owned: DataFrame, postings: DataFrame, codes: DataFrame, luts: DataFrame, n: int, keys: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """Each owner's number of distinct candidates, and its first n. A pair of query and vector is scored once, however many owners it has.

    Candidates are many more than the probed lists they come from, so they are dealt by the number of queries, not by the size of those."""
    parts = max(1, -(-luts.select("qid").count() // APART))
    c = owned.join(postings.select("list_id", "vec_id"), "list_id").select(*keys, "qid", "node", "vec_id").repartition(parts, "qid").distinct()
    adc = I.score(c.select("qid", "vec_id").distinct(), codes, luts).select("qid", "vec_id", "adc")
    n_of = c.groupBy(*keys, "qid", "node").agg(F.count("*").alias("scored"))
    return n_of, I.top(c.join(adc, ["qid", "vec_id"]), "adc", n, (*keys, "qid", "node"))


def _first(passed: DataFrame, n: int, keys: tuple = ()) -> DataFrame:
    """As merge_origin, per keys too."""
    one = passed.groupBy(*keys, "qid", "vec_id").agg(F.min("adc").alias("adc"), F.min("node").alias("node"))
    return I.top(one, "adc", n, (*keys, "qid"))


def _read(picked: DataFrame, layout: DataFrame, keys: tuple = ()) -> DataFrame:
    """keys, qid, node, ids, pages: what a re-ranking call is given, and the different pages that it reads."""
    return picked.join(layout.select("vec_id", "page"), "vec_id").groupBy(*keys, "qid", "node").agg(F.count("*").alias("ids"), F.countDistinct("page").alias("pages"))


def owner_work(owned: DataFrame, postings: DataFrame, codes: DataFrame, luts: DataFrame, layout: DataFrame, n: int, keys: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """keys, qid, node, scored, ids, pages of the two-phase plan (0 where a call isn't made), and its merged first n."""
    by = [*keys, "qid", "node"]
    scored, passed = _passed(owned, postings, codes, luts, n, keys)
    merged = _first(passed, n, keys)
    work = owned.select(*by).distinct().join(scored, by, "left").join(_read(merged, layout, keys), by, "left")
    return work.fillna(0, ["scored", "ids", "pages"]), merged


def hottest(work: DataFrame, nodes, keys: tuple = ()) -> DataFrame:
    """keys, hot: the greatest mean of an owner's scored candidates, pages and calls, each over its mean of all nodes."""
    load = work.groupBy(*keys, "node").agg(F.sum("scored").alias("s"), F.sum("pages").alias("p"), (F.count("*") + F.count_if(F.col("ids") > 0)).alias("c"))
    every = Window.partitionBy(*keys)
    part = lambda c: F.col(c).cast("double") * nodes / F.sum(c).over(every)
    return load.select(*keys, ((part("s") + part("p") + part("c")) / 3).alias("x")).groupBy(*keys).agg(F.round(F.max("x"), 6).alias("hot"))


def hot_owner(owned: DataFrame, postings: DataFrame, codes: DataFrame, luts: DataFrame, layout: DataFrame, n: int, nodes: int) -> DataFrame:
    return hottest(owner_work(owned, postings, codes, luts, layout, n)[0], nodes)


def overhead(probed: DataFrame, list_part: DataFrame, t, layout: DataFrame, sizes: list[int], parts: int, p: I.Params) -> DataFrame:
    """The two-phase plan on every number of nodes, in one plan: nodes, means a query of owners that filter and re-rank, scored,
    pages and merge_in, their and the work's ratio to the first size, speedup, hot and mismatches with the first size's answers.

    t has post(), codes(), luts(), v and q. Scores and distances of a pair are worked out once for all sizes."""
    spark, keys = probed.sparkSession, ("nodes",)
    sized = spark.createDataFrame([(s, *divmod(parts, s)) for s in sizes], "nodes int, base int, rem int")
    edge = F.expr("rem * (base + 1)")
    node = F.when(F.col("part") < edge, F.expr("part div (base + 1)")).otherwise(F.expr("rem + (part - rem * (base + 1)) div greatest(base, 1)"))
    owned = probed.join(list_part, "list_id").join(F.broadcast(sized)).select("nodes", "qid", "list_id", node.cast("int").alias("node"))
    work, merged = owner_work(owned, t.post(), t.codes(), t.luts(), layout, p.n, keys)
    s = work.groupBy("nodes").agg(
        F.countDistinct("qid").alias("q"), F.count("*").alias("f"), F.count_if(F.col("ids") > 0).alias("r"), F.sum("scored").alias("scored"), F.sum("pages").alias("pages"), F.sum(F.least(F.lit(p.n), "scored")).alias("merge_in")
    )
    us = F.lit(RPC + FILTER) * F.col("f") + F.lit(SCORED) * F.col("scored") + F.lit(RPC + RERANK) * F.col("r") + F.lit(PAGE) * F.col("pages") + F.lit(2 * MERGE) * F.col("q") + F.lit(MERGED) * (F.col("merge_in") + F.col("r") * p.k)
    s = s.withColumn("us", us)
    one = s.where(F.col("nodes") == sizes[0]).select(F.col("scored").alias("s1"), F.col("pages").alias("p1"), F.col("us").alias("w1"))
    mean = lambda c, name: F.round(F.col(c) / F.col("q"), 6).alias(name)
    ratio = lambda c, base, name: F.round(F.col(c) / F.col(base), 6).alias(name)
    s = s.join(F.broadcast(one)).select(
        "nodes", mean("f", "owners_f"), mean("r", "owners_r"), mean("scored", "scored"), ratio("scored", "s1", "scored_x1"), mean("pages", "pages"), ratio("pages", "p1", "pages_x1"), mean("merge_in", "merge_in"),
        ratio("us", "w1", "work_x1"), F.round(F.col("nodes") * F.col("w1") / F.col("us"), 6).alias("speedup")
    )
    dist = I.exact_scores(merged.select("qid", "vec_id").distinct(), t.v, t.q)
    best = I.top(merged.select("nodes", "qid", "vec_id").join(dist, ["qid", "vec_id"]), "dist", p.k, ("nodes", "qid"))
    ids = best.groupBy("nodes", "qid").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))).alias("ids"))
    other = F.col("ids") != F.min_by("ids", F.when(F.col("nodes") == sizes[0], 0).otherwise(1)).over(Window.partitionBy("qid"))
    wrong = ids.withColumn("other", other).groupBy("nodes").agg(F.count_if("other").alias("mismatches"))
    return s.join(hottest(work, F.col("nodes"), keys), "nodes").join(wrong, "nodes")


def strategy_costs(owned: DataFrame, postings: DataFrame, codes: DataFrame, luts: DataFrame, layout: DataFrame, p: I.Params, navigate: float = 0.0) -> DataFrame:
    """qid, strategy, calls, reranked, pages, work, latency of the four strategies, in microseconds of the cost model.

    Work adds all owners, latency takes the slowest of each phase. A fused call filters and re-ranks: always in the local
    strategies, in two-phase+1 where one node owns all lists."""
    scored, passed = _passed(owned, postings, codes, luts, p.n)
    share = F.ceil(F.lit(float(p.n)) * F.col("scored") / F.sum("scored").over(Window.partitionBy("qid")))
    groups = owned.select("qid", "node").distinct().join(scored, ["qid", "node"], "left").fillna(0, ["scored"]).withColumn("quota", share)
    named = lambda df, *names: df.select("qid", "node", "vec_id", F.explode(F.array(*[F.lit(x) for x in names])).alias("strategy"))
    own_share = passed.join(groups.select("qid", "node", "quota"), ["qid", "node"]).where("rank <= quota")
    picked = named(_first(passed, p.n), *COSTED[:2]).unionByName(named(passed, "local")).unionByName(named(own_share, "local-quota"))
    every = groups.withColumn("strategy", F.explode(F.array(*[F.lit(x) for x in COSTED])))
    every = every.join(_read(picked, layout, ("strategy",)), ["strategy", "qid", "node"], "left").fillna(0, ["ids", "pages"])
    asked = F.col("ids") > 0
    f = F.lit(FILTER) + F.lit(SCORED) * F.col("scored")
    r = F.when(asked, F.lit(RERANK) + F.lit(PAGE) * F.col("pages")).otherwise(F.lit(0.0))
    s = every.groupBy("qid", "strategy").agg(
        F.count("*").alias("owners"), F.count_if(asked).alias("answered"), F.sum("scored").alias("scored"), F.sum(F.least(F.lit(p.n), "scored")).alias("returned"), F.sum("ids").alias("reranked"), F.sum("pages").alias("pages"),
        F.max(F.lit(RPC) + f).alias("slow_f"), F.max(F.when(asked, F.lit(RPC) + r).otherwise(F.lit(0.0))).alias("slow_r"), F.max(F.lit(RPC) + f + r).alias("slow")
    )
    fused = F.col("strategy").startswith("local") | (F.col("strategy") == "two-phase+1") & (F.col("owners") == 1)
    filtered = F.lit(RPC + FILTER) * F.col("owners") + F.lit(SCORED) * F.col("scored")
    ranked = F.lit(RERANK) * F.col("answered") + F.lit(PAGE) * F.col("pages")
    last, merge = F.lit(MERGE) + F.lit(MERGED) * (F.col("answered") * p.k), F.lit(MERGE) + F.lit(MERGED) * F.col("returned")
    work = filtered + ranked + last + F.when(fused, F.lit(0.0)).otherwise(F.lit(RPC) * F.col("answered") + merge)
    latency = F.when(fused, F.col("slow") + last).otherwise(F.col("slow_f") + merge + F.col("slow_r") + last)
    calls = F.col("owners") + F.when(fused, F.lit(0)).otherwise(F.col("answered"))
    return s.select("qid", "strategy", calls.alias("calls"), "reranked", "pages", F.round(work + navigate, 4).alias("work"), F.round(latency + navigate, 4).alias("latency"))


def local_strategy(owned: DataFrame, postings: DataFrame, codes: DataFrame, luts: DataFrame, vectors: DataFrame, queries: DataFrame, p: I.Params) -> DataFrame:
    """qid, rank, vec_id, dist: every owner filters its first n and re-ranks them."""
    return local_rerank(owner_filter(owned, postings, codes, luts, p.n), vectors, queries, p.k)


def local_quota_strategy(owned: DataFrame, postings: DataFrame, codes: DataFrame, luts: DataFrame, vectors: DataFrame, queries: DataFrame, p: I.Params) -> DataFrame:
    """As local_strategy(), but an owner re-ranks its share of n only."""
    return local_rerank(owner_filter(owned, postings, codes, luts, p.n, quota=True), vectors, queries, p.k)


def recall(truth: DataFrame, answers: DataFrame, k: int) -> DataFrame:
    """queries, recall: shared ids over k."""
    hit = truth.join(answers.select("qid", "vec_id", F.lit(1).alias("x")), ["qid", "vec_id"], "left").groupBy("qid").agg(F.count("x").alias("hit"))
    return hit.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("hit") / F.lit(float(k))), 6).alias("recall"))


def recall_by_distance(truth: DataFrame, answers: DataFrame) -> DataFrame:
    """qid, hits: answers no farther than the last true neighbour, so ties count."""
    kth = truth.groupBy("qid").agg(F.max("dist").alias("kth"))
    return answers.join(kth, "qid").groupBy("qid").agg(F.count_if(F.col("dist") <= F.col("kth")).alias("hits"))


def sweep(t, settings: list[tuple[int, int]], truth: DataFrame) -> DataFrame:
    """nprobe, n, answers, hits: every setting in one plan; postings, codes and tables are read once."""
    p = t.spark.createDataFrame(settings, "nprobe int, n int")
    nav = t.nav().join(F.broadcast(p)).where("pos <= nprobe")
    cand = nav.join(t.post().select("list_id", "vec_id"), "list_id").select("nprobe", "n", "qid", "vec_id").distinct()
    keys = ("nprobe", "n", "qid")
    w = Window.partitionBy(*keys).orderBy("adc", "vec_id")
    f = I.score(cand, t.codes(), t.luts()).withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.col("n")).drop("r")
    best = I.rerank(f, t.v, t.q, 10, keys)
    hit = best.join(truth.select("qid", "vec_id", F.lit(1).alias("x")), ["qid", "vec_id"], "left")
    return hit.groupBy("nprobe", "n").agg(F.count("*").alias("answers"), F.count("x").alias("hits"))
