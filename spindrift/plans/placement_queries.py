"""Registered queries of placement, migration and epochs."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import distributed as D
from spindrift.operators import placement as M
from spindrift.operators import stores as St
from spindrift.operators.ranking import numbered
from spindrift.plans.declare import query
from spindrift.plans.vector_queries import CTE, NEEDS, Tables, sql

# the index's posting lists, each a partition, on 4 nodes; a fifth joins
def _even_sql(k: int) -> str:
    """Contiguous blocks, the first n % k of them one larger."""
    edge = f"(n % {k}) * (n // {k} + 1)"
    return f"SELECT part, CAST(CASE WHEN part < {edge} THEN part // (n // {k} + 1) ELSE n % {k} + (part - {edge}) // greatest(n // {k}, 1) END AS INTEGER) AS node FROM lists, total"


PLACED = {
    "lists": "SELECT CAST(row_number() OVER (ORDER BY list_id) - 1 AS INTEGER) AS part FROM h",
    "total": "SELECT count(*) AS n FROM h",
    "four": _even_sql(4),
    "five": _even_sql(5),
    # a fifth node joins: each gives what is above its goal, from the end
    "goals": "SELECT node, own, n // 5 + CASE WHEN row_number() OVER (ORDER BY own DESC, node) <= n % 5 THEN 1 ELSE 0 END AS goal FROM (SELECT node, count(*) AS own FROM four GROUP BY node), total",
    "moves": "SELECT node AS src, CAST(4 AS INTEGER) AS dst, part FROM (SELECT part, node, row_number() OVER (PARTITION BY node ORDER BY part DESC) - 1 AS depth FROM four) JOIN goals USING (node) WHERE depth < own - goal",
    "joined": "SELECT part, CAST(coalesce(dst, node) AS INTEGER) AS node FROM four LEFT JOIN moves USING (part)",
    # the last of five leaves: its partitions from the end, to the others by what they need
    "back": "SELECT node, own, n // 4 + CASE WHEN row_number() OVER (ORDER BY own DESC, node) <= n % 4 THEN 1 ELSE 0 END AS goal FROM (SELECT node, count(*) AS own FROM five WHERE node < 4 GROUP BY node), total",
    "slots": "SELECT node, sum(goal - own) OVER (ORDER BY node) AS hi, goal - own AS need FROM back WHERE goal > own",
}


def _placed(body: str) -> str:
    return sql(body, "h", **PLACED)


def _parts(spark, sf):
    heads = numbered(Tables(spark, sf).h.select("list_id"), [F.col("list_id")], "nth")
    return heads.select((F.col("nth") - 1).cast("int").alias("part"))


def _old(spark, sf):
    return D.evenly_placed(_parts(spark, sf), [0, 1, 2, 3])


def _moves(spark, sf):
    return M.scale_out(_old(spark, sf), [0, 1, 2, 3, 4])


def _joined(spark, sf):
    return M.apply_moves(_old(spark, sf), _moves(spark, sf))


@query("M2_even_placement", _placed("SELECT part, node FROM five"))
def even(spark, sf):
    return D.evenly_placed(_parts(spark, sf), [0, 1, 2, 3, 4])


@query("M3_scale_out", _placed("SELECT src, dst, part FROM moves"))
def scale_out(spark, sf):
    return _moves(spark, sf).select("src", "dst", "part")


@query("M8_plan", _placed("SELECT dst, src, list_sort(list(part)) AS parts FROM moves GROUP BY dst, src"))
def plan(spark, sf):
    return M.plan(_moves(spark, sf))


@query("J14_diff", _placed("SELECT o.node AS src, n.node AS dst, part FROM four o JOIN joined n USING (part) WHERE o.node <> n.node"))
def diff(spark, sf):
    return M.diff(_old(spark, sf), _joined(spark, sf))


@query("W5_ranges", _placed("SELECT node, min(part) AS lo, max(part) AS hi FROM (SELECT part, node, part - row_number() OVER (PARTITION BY node ORDER BY part) AS g FROM joined) GROUP BY node, g"))
def ranges(spark, sf):
    return M.ranges(_joined(spark, sf))


@query("M9_from_ranges", _placed("SELECT node, part FROM joined"))
def from_ranges(spark, sf):
    return M.from_ranges(ranges(spark, sf))


@query("A13_partition_counts", _placed("SELECT node, count(*) AS parts, min(part) AS first_part FROM joined GROUP BY node"))
def counts(spark, sf):
    return _joined(spark, sf).groupBy("node").agg(F.count("*").alias("parts"), F.min("part").alias("first_part"))


@query("M10_history", _placed("SELECT part, node FROM four UNION SELECT part, node FROM joined"))
def history(spark, sf):
    return _old(spark, sf).union(_joined(spark, sf)).distinct()


@query("M1_set_operations", _placed("SELECT 'both' AS kind, count(*) AS n FROM (FROM four INTERSECT FROM joined) UNION ALL SELECT 'old', count(*) FROM (FROM four EXCEPT FROM joined) UNION ALL SELECT 'any', count(*) FROM (FROM four UNION FROM joined)"))
def set_operations(spark, sf):
    a, b = _old(spark, sf), _joined(spark, sf)
    n = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(a.intersect(b), "both").unionByName(n(a.subtract(b), "old")).unionByName(n(a.union(b).distinct(), "any"))


# --- node stores: 8 partitions of the index on two nodes, a third joins -----------------------------------------

CTE["pold"] = "SELECT CAST(part AS INTEGER) AS part, CAST(part // 4 AS INTEGER) AS node FROM (SELECT unnest(range(8)) AS part)"
CTE["pmoves"] = "SELECT part // 4 AS src, 2 AS dst, part FROM (SELECT unnest([3, 7]) AS part)"
CTE["pnamed"] = "SELECT DISTINCT part, vec_id FROM post JOIN lp USING (list_id)"
CTE["pmiss"] = "SELECT m.dst, min(m.src) AS src, n.vec_id FROM pnamed n JOIN pmoves m USING (part) WHERE NOT EXISTS (SELECT 1 FROM pnamed n2 JOIN pold o ON o.part = n2.part WHERE o.node = m.dst AND n2.vec_id = n.vec_id) GROUP BY m.dst, n.vec_id"
CTE["pbytes"] = "SELECT lp.part, count(*) * 4 + (count(*) + 1) * 8 + coalesce(sum(n), 0) * 8 AS bytes FROM lp LEFT JOIN (SELECT list_id, count(*) AS n FROM post GROUP BY list_id) USING (list_id) GROUP BY lp.part"
NEEDS.update({"pnamed": ["post", "lp"], "pmiss": ["pnamed", "pmoves", "pold"], "pbytes": ["lp", "post"]})


class Move(Tables):
    """The recipe's tables with two placements."""

    def __init__(self, spark, sf):
        super().__init__(spark, sf)
        self.old = D.even_placement(spark, 8, [0, 1])
        self.moves = M.scale_out(self.old, [0, 1, 2])
        self.new = M.apply_moves(self.old, self.moves)

    def by(self):
        return M.named(self.lp(), self.post())


@query("J9_codes_missing", sql("SELECT CAST(dst AS INTEGER) AS dst, CAST(src AS INTEGER) AS src, vec_id FROM pmiss", "pmiss"))
def codes_missing(spark, sf):
    t = Move(spark, sf)
    return M.missing(t.moves, t.by(), M.held(t.old, t.by())).select(F.col("dst").cast("int").alias("dst"), F.col("src").cast("int").alias("src"), "vec_id")


@query("J10_raw_missing", sql("SELECT CAST(dst AS INTEGER) AS dst, l.loc FROM pmiss JOIN seqlay l USING (vec_id)", "pmiss", "seqlay"))
def raw_missing(spark, sf):
    from spindrift.operators.index import sequential_layout

    t = Move(spark, sf)
    return codes_missing(spark, sf).join(sequential_layout(t.v, 16), "vec_id").select("dst", "loc")


@query("J12_live_codes", sql("SELECT node, vec_id FROM (SELECT DISTINCT node, vec_id FROM pnamed JOIN pold USING (part))", "pnamed", "pold"))
def live_codes(spark, sf):
    t = Move(spark, sf)
    return M.held(t.old, t.by())


@query("A12_references", sql("SELECT node, vec_id, count(*) AS refs FROM post JOIN lp USING (list_id) JOIN pold USING (part) GROUP BY node, vec_id", "post", "lp", "pold"))
def references(spark, sf):
    t = Move(spark, sf)
    return M.references(t.old, t.lp(), t.post())


@query("A11_store_states", sql("""SELECT node, state, count(*) AS n FROM (
  SELECT h.node, h.vec_id, CASE WHEN r.vec_id IS NOT NULL THEN 'live' ELSE 'cached' END AS state
  FROM (SELECT DISTINCT node, vec_id FROM pnamed JOIN pold USING (part)) h LEFT JOIN (SELECT DISTINCT o.node, n.vec_id FROM pnamed n JOIN pold o USING (part) WHERE part NOT IN (SELECT part FROM pmoves)) r ON r.node = h.node AND r.vec_id = h.vec_id) GROUP BY node, state""", "pnamed", "pold", "pmoves"))
def store_states(spark, sf):
    """Codes of the old owners once the moved partitions are evicted: live if a resident partition names them, else cached."""
    t = Move(spark, sf)
    by = t.by()
    rest = M.held(t.old.join(t.moves, "part", "left_anti"), by).withColumn("x", F.lit(1))
    state = F.when(F.col("x").isNotNull(), "live").otherwise("cached")
    return M.held(t.old, by).join(rest, ["node", "vec_id"], "left").groupBy("node", state.alias("state")).agg(F.count("*").alias("n"))


@query("A14_segment_bytes", sql("SELECT part, CAST(bytes AS BIGINT) AS bytes FROM pbytes", "pbytes"))
def segment_bytes(spark, sf):
    t = Move(spark, sf)
    return M.segment_bytes(t.lp(), t.post())


@query("A24_dedup_savings", sql("SELECT (SELECT count(*) FROM pmiss) AS pulled, (SELECT count(*) FROM pnamed JOIN pmoves USING (part)) AS per_partition", "pmiss", "pnamed", "pmoves"))
def dedup_savings(spark, sf):
    t = Move(spark, sf)
    a = codes_missing(spark, sf).agg(F.count("*").alias("pulled"))
    return a.crossJoin(t.by().join(t.moves, "part").agg(F.count("*").alias("per_partition")))


@query("S24_pull_records", sql("SELECT CAST(dst AS INTEGER) AS dst, CAST(src AS INTEGER) AS src, count(*) AS records, CAST(count(*) * 8 AS BIGINT) AS bytes, CAST(ceil(count(*) / 64.0) AS BIGINT) AS batches FROM pmiss GROUP BY dst, src", "pmiss"))
def pull_records(spark, sf):
    return codes_missing(spark, sf).groupBy("dst", "src").agg(F.count("*").alias("records"), (F.count("*") * 8).alias("bytes"), F.ceil(F.count("*") / F.lit(64.0)).alias("batches"))


@query("M15_ledger", sql("SELECT 'lazy' AS protocol, (SELECT count(*) FROM pmoves) AS moved, n AS pq_codes, n AS raw_vectors, CAST(b + n * 8 AS BIGINT) AS bytes FROM (SELECT count(*) AS n FROM pmiss), (SELECT sum(bytes) AS b FROM pbytes JOIN pmoves USING (part))", "pmiss", "pmoves", "pbytes"))
def ledger(spark, sf):
    t = Move(spark, sf)
    return M.ledger("lazy", t.old, t.new, t.lp(), t.post())


@query("J17_location_conflicts", sql("SELECT count(*) AS conflicts FROM (SELECT vec_id FROM pnamed JOIN pold USING (part) GROUP BY vec_id HAVING count(DISTINCT CASE WHEN node = 0 THEN vec_id ELSE 1000000 + vec_id END) > 1)", "pnamed", "pold"))
def location_conflicts(spark, sf):
    """Vectors that two nodes hold under different locations: one counts them from 0, the other from a million."""
    t = Move(spark, sf)
    loc = F.col("vec_id") + F.when(F.col("node") == 0, 0).otherwise(1_000_000)
    j = M.held(t.old, t.by()).withColumn("loc", loc).groupBy("vec_id").agg(F.countDistinct("loc").alias("n"))
    return j.agg(F.count_if(F.col("n") > 1).alias("conflicts"))


@query("P11_not_resident", sql("SELECT DISTINCT list_id FROM nav WHERE list_id NOT IN (SELECT list_id FROM lp JOIN pold USING (part) WHERE node = 0)", "nav", "lp", "pold"))
def not_resident(spark, sf):
    t = Move(spark, sf)
    resident = t.lp().join(t.old.where("node = 0"), "part").select("list_id")
    return t.nav().select("list_id").distinct().join(resident, "list_id", "left_anti")


@query("J13_fetch_on_demand", sql("SELECT CAST(src AS INTEGER) AS src, count(*) AS fetched FROM (SELECT DISTINCT f.vec_id FROM filt f) a JOIN pmiss m USING (vec_id) GROUP BY src", "filt", "pmiss"))
def fetch_on_demand(spark, sf):
    """Vectors that the searches' filters name and the joining node has not yet, by the source they are pending from."""
    t = Move(spark, sf)
    return t.filt().select("vec_id").distinct().join(codes_missing(spark, sf), "vec_id").groupBy("src").agg(F.count("*").alias("fetched"))


@query("P15_roles", _placed("SELECT node, count(*) > 0 AS is_owner, node % 2 = 0 AS is_entry FROM joined GROUP BY node"))
def roles(spark, sf):
    return _joined(spark, sf).groupBy("node").agg((F.count("*") > 0).alias("is_owner")).withColumn("is_entry", F.col("node") % 2 == 0)


@query("M4_scale_in", _placed("SELECT CAST(4 AS INTEGER) AS src, s.node AS dst, part FROM (SELECT part, row_number() OVER (ORDER BY part DESC) - 1 AS pick FROM five WHERE node = 4) g JOIN slots s ON pick >= hi - need AND pick < hi"))
def scale_in(spark, sf):
    """The lists on 5 nodes, the last leaves: its partitions go from the end to the others in turn of need."""
    return M.scale_in(D.evenly_placed(_parts(spark, sf), [0, 1, 2, 3, 4]), [0, 1, 2, 3])


@query("M5_reversible_scale_in", _placed("SELECT dst AS src, src AS dst, part FROM moves"))
def reversible(spark, sf):
    """The node that joined leaves again: what it was given goes home."""
    old, new = _old(spark, sf), _joined(spark, sf)
    return M.scale_in(new, [0, 1, 2, 3], old.union(new))


_NODES = "(SELECT DISTINCT CAST(user_id % 10 AS INTEGER) AS node, user_id % 10 < 6 AS active FROM events)"


@query("M14_rescale_nodes", f"SELECT 'join' AS what, node FROM (SELECT node FROM {_NODES} WHERE NOT active ORDER BY node LIMIT 2) UNION ALL SELECT 'leave', node FROM (SELECT node FROM {_NODES} WHERE active ORDER BY node DESC LIMIT 3)")
def rescale_nodes(spark, sf):
    """Of the nodes that have reported (6 active, the others idle): who joins for a target of 8, who leaves for one of 3."""
    n = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 10).cast("int").alias("node")).distinct().withColumn("active", F.col("node") < 6)
    active = n.where("active").count()
    return M.rescaled(n, active + 2).unionByName(M.rescaled(n, active - 3))


@query("A11_all_states", sql("""SELECT node, state, count(*) AS n FROM (
  SELECT h.node, CASE WHEN r.vec_id IS NOT NULL THEN 'live' ELSE 'cached' END AS state
  FROM (SELECT DISTINCT node, vec_id FROM pnamed JOIN pold USING (part)) h LEFT JOIN (SELECT DISTINCT o.node, n.vec_id FROM pnamed n JOIN pold o USING (part) WHERE part NOT IN (SELECT part FROM pmoves)) r ON r.node = h.node AND r.vec_id = h.vec_id
  UNION ALL SELECT CAST(dst AS INTEGER), 'staged' FROM pmiss) GROUP BY node, state""", "pnamed", "pold", "pmoves", "pmiss"))
def all_states(spark, sf):
    """The stores in the middle of a rescale: the joining node's codes are staged, the donors' are live or cached."""
    staged = codes_missing(spark, sf).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).select("node", F.lit("staged").alias("state"), "n")
    return store_states(spark, sf).unionByName(staged)


@query("M15_protocols", sql("SELECT protocol, (SELECT count(*) FROM pmoves) AS moved, n AS pq_codes, CASE protocol WHEN 'lazy' THEN n ELSE 0 END AS streamed_after_flip, CASE protocol WHEN 'lazy' THEN 0 ELSE n END AS copied_before_flip FROM (SELECT count(*) AS n FROM pmiss), (SELECT unnest(['lazy', 'copy-then-flip', 'stop-and-copy']) AS protocol)", "pmiss", "pmoves"))
def protocols(spark, sf):
    """What each protocol moves, and whether raw vectors travel before or after the new epoch serves."""
    t = Move(spark, sf)
    out = None
    for name in M.PHASES:
        after = M.PHASES[name].index("flip") < M.PHASES[name].index("stream_raw") if "stream_raw" in M.PHASES[name] else False
        n = F.col("raw_vectors")
        one = M.ledger(name, t.old, t.new, t.lp(), t.post()).select("protocol", "moved", "pq_codes", (n if after else n * 0).alias("streamed_after_flip"), (n * 0 if after else n).alias("copied_before_flip"))
        out = one if out is None else out.unionByName(one)
    return out


# --- stores as tables, from the log of events ---------------------------------------------------------------------

_LOG = "log AS (SELECT CAST(user_id % 3 AS INTEGER) AS node, event_id % 40 AS vec_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'put' WHEN 'view' THEN 'ref' WHEN 'click' THEN 'unref' WHEN 'purchase' THEN 'reserve' ELSE 'release' END AS op FROM events)"
_STATES = _LOG + """, g AS (SELECT node, vec_id, count(*) FILTER (WHERE op = 'ref') - count(*) FILTER (WHERE op = 'unref') AS refs, coalesce(max(seq) FILTER (WHERE op = 'put'), -1) AS put, coalesce(max(seq) FILTER (WHERE op = 'ref'), -1) AS ref,
  coalesce(max(seq) FILTER (WHERE op = 'reserve'), -1) AS reserve, coalesce(max(seq) FILTER (WHERE op = 'release'), -1) AS release FROM log WHERE vec_id IS NOT NULL GROUP BY node, vec_id),
st AS (SELECT node, vec_id, refs, CASE WHEN refs > 0 THEN 'live' WHEN ref < 0 OR reserve > greatest(ref, release) THEN 'staged' ELSE 'cached' END AS state FROM g WHERE ref >= 0 OR put > release)"""


def _log(spark, sf):
    op = F.col("event_type")
    op = F.when(op == "signup", "put").when(op == "view", "ref").when(op == "click", "unref").when(op == "purchase", "reserve").otherwise("release")
    return spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 3).cast("int").alias("node"), (F.col("event_id") % 40).alias("vec_id"), F.col("event_id").alias("seq"), op.alias("op"))


@query("M11_code_states", f"WITH {_STATES} SELECT node, vec_id, refs, state FROM st")
def code_states(spark, sf):
    return St.code_states(_log(spark, sf))


_CAPACITY = "CASE node WHEN 0 THEN 45 WHEN 1 THEN 36 ELSE 100 END"


@query("M11_eviction", f"""WITH {_STATES}, used AS (SELECT node, vec_id, max(seq) AS used FROM log GROUP BY node, vec_id),
  held AS (SELECT * FROM st JOIN used USING (node, vec_id)),
  asked AS (SELECT DISTINCT CAST(user_id % 3 AS INTEGER) AS node, event_id % 60 AS vec_id FROM events WHERE event_type = 'signup' AND event_id % 60 >= 30),
  new AS (SELECT node, vec_id FROM asked WHERE (node, vec_id) NOT IN (SELECT (node, vec_id) FROM held)),
  n AS (SELECT node, count(*) AS new FROM new GROUP BY node), h AS (SELECT node, count(*) AS held, count(*) FILTER (WHERE state = 'cached') AS cached FROM held GROUP BY node),
  want AS (SELECT node, greatest(coalesce(held, 0) + new - {_CAPACITY}, 0) AS need, coalesce(cached, 0) AS cached FROM n LEFT JOIN h USING (node)),
  victims AS (SELECT node, vec_id, row_number() OVER (PARTITION BY node ORDER BY used, vec_id) AS r FROM held WHERE state = 'cached')
SELECT node, vec_id, CASE WHEN need <= cached THEN 'install' ELSE 'refuse' END AS change FROM new JOIN want USING (node)
UNION ALL SELECT node, vec_id, 'evict' FROM victims JOIN want USING (node) WHERE need <= cached AND r <= need""")
def eviction(spark, sf):
    """New codes for stores of 45, 36 and 100 slots: what they install, what has to go for it, and who must refuse."""
    log = _log(spark, sf)
    used = log.where("vec_id is not null").groupBy("node", "vec_id").agg(F.max("seq").alias("used"))
    held = St.code_states(log).join(used, ["node", "vec_id"])
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'signup' and event_id % 60 >= 30")
    asked = e.select((F.col("user_id") % 3).cast("int").alias("node"), (F.col("event_id") % 60).alias("vec_id"))
    slots = spark.createDataFrame([(0, 45), (1, 36), (2, 100)], "node int, slots long")
    return St.admitted(held, asked, slots)


@query("A11_code_stats", f"WITH {_STATES} SELECT node, count(*) AS resident, count(*) FILTER (WHERE state = 'live') AS live, count(*) FILTER (WHERE state = 'staged') AS staged, count(*) FILTER (WHERE state = 'cached') AS cached FROM st GROUP BY node")
def code_stats(spark, sf):
    return St.code_stats(code_states(spark, sf))


_RAW = """n AS (SELECT max(vec_id) + 1 AS n FROM embeddings), have AS (SELECT vec_id AS loc, 'index' AS origin, vec_id AS data FROM embeddings WHERE vec_id % 4 = 0),
batch AS (SELECT event_id * 7 % n AS loc, CASE WHEN event_type = 'view' THEN 'streamed' ELSE 'fetched' END AS origin, event_id AS data FROM events, n),
stored AS (SELECT * FROM have UNION ALL SELECT loc, arg_min(origin, data), min(data) FROM batch WHERE loc NOT IN (SELECT loc FROM have) GROUP BY loc)"""


def _raw(spark, sf):
    """Raw vectors that a node has from the index, and a batch of others that comes in twice over."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id")
    have = e.where("vec_id % 4 = 0").select(F.col("vec_id").alias("loc"), F.lit("index").alias("origin"), F.col("vec_id").alias("data"))
    n = e.agg((F.max("vec_id") + 1).alias("n"))
    batch = spark.read.parquet(f"{sf}/events.parquet").join(F.broadcast(n)).select((F.col("event_id") * 7 % F.col("n")).alias("loc"), F.when(F.col("event_type") == "view", "streamed").otherwise("fetched").alias("origin"), F.col("event_id").alias("data"), F.col("event_id").alias("seq"))
    return have, batch


@query("M12_raw_put", f"WITH {_RAW} SELECT loc, origin, data FROM stored")
def raw_put(spark, sf):
    return St.raw_put(*_raw(spark, sf))


@query("M12_raw_missing", f"WITH {_RAW} SELECT DISTINCT loc FROM batch WHERE loc NOT IN (SELECT loc FROM have)")
def raw_missing(spark, sf):
    have, batch = _raw(spark, sf)
    return St.raw_missing(batch, have)


@query("M12_raw_stats", f"WITH {_RAW} SELECT origin, count(*) AS n FROM stored GROUP BY origin")
def raw_stats(spark, sf):
    return St.raw_stats(raw_put(spark, sf))


@query("M12_raw_get", f"WITH {_RAW} SELECT b.loc, b.data AS asked, s.data FROM batch b JOIN stored s USING (loc)")
def raw_get(spark, sf):
    _, batch = _raw(spark, sf)
    return St.raw_get(batch.select("loc", F.col("data").alias("asked")), raw_put(spark, sf))


@query("P12_in_range", f"WITH {_RAW} SELECT loc, count(*) AS n FROM batch GROUP BY loc")
def in_range(spark, sf):
    n = spark.read.parquet(f"{sf}/embeddings.parquet").agg((F.max("vec_id") + 1).alias("n"))
    _, batch = _raw(spark, sf)
    return St.in_range(batch.join(F.broadcast(n)), "loc", F.col("n")).groupBy("loc").agg(F.count("*").alias("n"))


@query("M13_resident", sql("SELECT node, list(part ORDER BY part) AS parts, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT CAST(coalesce(m.dst, o.node) AS INTEGER) AS node, part FROM pold o LEFT JOIN pmoves m USING (part)) JOIN pbytes USING (part) GROUP BY node", "pold", "pmoves", "pbytes"))
def resident(spark, sf):
    """After a rescale: the partitions that each node holds once the new ones are loaded and the old ones evicted, and their bytes."""
    t = Move(spark, sf)
    gone = t.moves.select(F.col("src").alias("node"), "part")
    now = St.evict(St.load(t.old, t.moves.select(F.col("dst").alias("node"), "part")), gone)
    return now.join(M.segment_bytes(t.lp(), t.post()), "part").groupBy("node").agg(F.sort_array(F.collect_list("part")).alias("parts"), F.sum("bytes").alias("bytes"))
