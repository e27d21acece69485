"""Registered queries over `events` as metric samples and latencies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.operators import metrics as M
from spindrift.operators.ranking import prefix_sums, runs
from spindrift.plans.declare import SQL, query

S = "s AS MATERIALIZED (SELECT event_id, ts, user_id AS node, event_type AS type, value, CAST(floor(value * 1000) AS BIGINT) AS us, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status FROM events WHERE ts IS NOT NULL)"


def _s(spark, sf):
    return M.samples(spark.read.parquet(f"{sf}/events.parquet"))


def _q(q: float) -> str:
    return f"list_sort(list(us))[CAST(least(count(*) - 1, floor({q} * count(*))) AS BIGINT) + 1]"


@query("A7_percentiles", f"WITH {S} SELECT type, {_q(0.5)} AS p50, {_q(0.99)} AS p99 FROM s WHERE us IS NOT NULL GROUP BY type")
def percentiles(spark, sf):
    return M.rank_quantiles(_s(spark, sf), ["type"], "us", {"p50": 0.5, "p99": 0.99})


@query("A8_percentiles_by_node", f"WITH {S} SELECT node, {_q(0.5)} AS p50, {_q(0.999)} AS p999, max(us) AS top FROM s WHERE us IS NOT NULL GROUP BY node")
def percentiles_by_node(spark, sf):
    return M.rank_quantiles(_s(spark, sf), ["node"], "us", {"p50": 0.5, "p999": 0.999, "top": 1.0})


_B = "CASE WHEN us <= 1 THEN 0 ELSE least(CAST(floor(ln(CAST(us AS DOUBLE)) / ln(1.05)) AS INTEGER) + 1, 379) END"


@query("A9_histogram", f"WITH {S} SELECT type, CAST({_B} AS INTEGER) AS bucket, count(*) AS n FROM s WHERE us IS NOT NULL GROUP BY ALL")
def histogram(spark, sf):
    return M.histogram(_s(spark, sf), ["type"])


@query("A9_histogram_quantiles", f"WITH {S}, h AS (SELECT type, CAST({_B} AS INTEGER) AS bucket, count(*) AS n FROM s WHERE us IS NOT NULL GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY type ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY type) AS total FROM h) SELECT type, CAST(sum(n) AS BIGINT) AS n, min(bucket) FILTER (WHERE upto >= ceil(0.5 * total)) AS p50, min(bucket) FILTER (WHERE upto >= ceil(0.99 * total)) AS p99 FROM c GROUP BY type")
def histogram_quantiles(spark, sf):
    return M.histogram_quantiles(_s(spark, sf), ["type"], {"p50": 0.5, "p99": 0.99})


@query("A10_snapshots", f"""WITH {S}, n AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS w, type, count(*) AS count, CAST(sum(us) AS BIGINT) AS sum_us FROM s GROUP BY ALL),
t AS (SELECT *, CAST(sum(count) OVER (PARTITION BY type ORDER BY w) AS BIGINT) AS total FROM n), d AS (SELECT *, total - coalesce(lag(total) OVER (PARTITION BY type ORDER BY w), 0) AS delta FROM t)
SELECT CAST(epoch(w) AS BIGINT) AS w, type, 'count' AS metric, count AS value FROM d UNION ALL SELECT CAST(epoch(w) AS BIGINT), type, 'total', total FROM d UNION ALL SELECT CAST(epoch(w) AS BIGINT), type, 'delta', delta FROM d UNION ALL SELECT CAST(epoch(w) AS BIGINT), type, 'sum_us', sum_us FROM d""")
def snapshots(spark, sf):
    return M.snapshots(_s(spark, sf)).withColumn("w", F.unix_timestamp("w"))


_W = 21600
_T = f"""{S}, b AS (SELECT min(ts) AS t0, max(ts) AS t1, greatest(1, CAST(ceil(((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 + 1e-9) / {_W}) AS BIGINT)) AS cnt FROM s),
r AS (SELECT s.*, least(cnt - 1, CAST(floor((epoch_us(ts) - epoch_us(t0)) / 1e6 / {_W}) AS BIGINT)) AS w FROM s, b),
n AS (SELECT w, count(*) AS offered, count(*) FILTER (WHERE status = 'ok') AS answered, count(*) FILTER (WHERE status <> 'ok') AS failed FROM r GROUP BY w),
p AS (SELECT w, {_q(0.5)} AS p50_us, {_q(0.99)} AS p99_us FROM r WHERE status = 'ok' AND us IS NOT NULL GROUP BY w),
tl AS (SELECT x.w, x.w * {_W} AS t_s, coalesce(offered, 0) AS offered, coalesce(answered, 0) AS answered, coalesce(failed, 0) AS failed, p50_us, p99_us FROM (SELECT unnest(range(cnt)) AS w FROM b) x LEFT JOIN n USING (w) LEFT JOIN p USING (w))"""


@query("T4_timeline", f"WITH {_T} SELECT w, t_s, offered, answered, failed, p50_us, p99_us FROM tl")
def timeline(spark, sf):
    return M.timeline(_s(spark, sf), _W)


@query("A21_saturation", f"WITH {_T} SELECT max(offered) AS saturation FROM tl WHERE answered * 100 >= offered * 95 AND failed = 0")
def saturation(spark, sf):
    return M.saturation(timeline(spark, sf))


@query("A22_status_counts", f"WITH {S} SELECT status, type, count(*) AS n FROM s GROUP BY status, type")
def status_counts(spark, sf):
    return _s(spark, sf).groupBy("status", "type").agg(F.count("*").alias("n"))


@query("A22_summary", f"WITH {S} SELECT count(*) AS queries, count(*) FILTER (WHERE status = 'ok') AS ok, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS seconds, round(count(*) FILTER (WHERE status = 'ok') / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS answered_per_s FROM s")
def summary(spark, sf):
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(1e6)
    ok = F.count_if(F.col("status") == "ok")
    return _s(spark, sf).agg(F.count("*").alias("queries"), ok.alias("ok"), F.round(span, 3).alias("seconds"), F.round(ok / span, 6).alias("answered_per_s"))


@query("A22_cube", f"WITH {S} SELECT type, status, count(*) AS n, CAST(sum(us) AS BIGINT) AS busy_us FROM s GROUP BY CUBE (type, status)")
def cube(spark, sf):
    return _s(spark, sf).cube("type", "status").agg(F.count("*").alias("n"), F.sum("us").alias("busy_us"))


@query("A23_operations", f"WITH {S} SELECT node, type, count(*) AS calls, count(*) FILTER (WHERE status = 'failed') AS errors, CAST(sum(us) AS BIGINT) AS busy_us FROM s GROUP BY node, type")
def operations(spark, sf):
    return _s(spark, sf).groupBy("node", "type").agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "failed").alias("errors"), F.sum("us").alias("busy_us"))


def _epochs(spark, sf):
    """An epoch starts with the first purchase of each day."""
    e = _s(spark, sf).where("type = 'purchase'").groupBy(F.to_date("ts").alias("d")).agg(F.min("ts").alias("ts"))
    return e.select(F.row_number().over(Window.orderBy("ts")).cast("long").alias("epoch"), "ts")


_E = f"{S}, e AS (SELECT row_number() OVER (ORDER BY ts) AS epoch, ts FROM (SELECT min(ts) AS ts FROM s WHERE type = 'purchase' GROUP BY CAST(ts AS DATE)))"


@query("J15_epoch_as_of", f"WITH {_E} SELECT s.event_id, e.epoch FROM s ASOF LEFT JOIN e ON s.ts >= e.ts")
def epoch_as_of(spark, sf):
    return M.as_of_epochs(_s(spark, sf).select("event_id", "ts"), _epochs(spark, sf)).select("event_id", "epoch")


@query("M17_drain_times", f"WITH {_E}, p AS (SELECT e.epoch, s.ts + to_microseconds(s.us) AS done FROM s ASOF JOIN e ON s.ts >= e.ts), m AS (SELECT epoch, max(done) AS done FROM p GROUP BY epoch) SELECT epoch, epoch_us(max(done) OVER (ORDER BY epoch)) AS drained_us FROM m")
def drain_times(spark, sf):
    """When the last query pinned to an epoch or an earlier one ends."""
    q = M.as_of_epochs(_s(spark, sf).select("event_id", "ts"), _epochs(spark, sf)).join(_s(spark, sf).select("event_id", "us"), "event_id").where("epoch is not null")
    m = q.groupBy("epoch").agg(F.max(F.unix_micros("ts") + F.col("us")).alias("done"))
    return m.select("epoch", F.max("done").over(Window.orderBy("epoch")).alias("drained_us"))


#: Groups of nodes whose queries the stream keeps together.
_GROUPS = 64


@query("T8_stream_drains", SQL["M17_drain_times"])
def stream_drains(spark, sf):
    """M17's drain times from a stream with keyed state and timers. A last row, far in the future, closes what the watermark has not passed.

    Only the last end on any node is asked for, so nodes are dealt over groups, and the state has an entry per group and epoch however many nodes there are."""
    from spindrift.folders import shared
    from spindrift.streaming import drains

    where = shared(spark, "drains")
    q = M.as_of_epochs(_s(spark, sf).select("event_id", "ts"), _epochs(spark, sf)).join(_s(spark, sf).select("event_id", "us", "node"), "event_id").where("epoch is not null")
    rows = q.select(F.pmod(F.xxhash64("node"), F.lit(_GROUPS)).alias("node"), "epoch", "ts", (F.unix_micros("ts") + F.col("us")).alias("done_us")).where("done_us is not null")
    rows.write.parquet(f"{where}/in")
    end = spark.read.schema(rows.schema).parquet(f"{where}/in").agg((F.max("done_us") + 60 * 86_400_000_000).alias("at")).select(F.lit(-1).cast("long").alias("node"), F.lit(-1).cast("long").alias("epoch"), F.timestamp_micros("at").alias("ts"), F.col("at").alias("done_us"))
    end.write.mode("append").parquet(f"{where}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{where}/in")
    drains.run(stream, f"{where}/out", f"{where}/state", "30 days").awaitTermination()
    told = spark.read.schema(drains.OUT).parquet(f"{where}/out").where("node >= 0")
    return drains.drained(spark, told)


@query("W7_epoch_marks", f"WITH {_E}, p AS (SELECT e.epoch, s.ts FROM s ASOF JOIN e ON s.ts >= e.ts), m AS (SELECT epoch, min(ts) AS ts FROM p GROUP BY epoch) SELECT epoch, epoch_us(ts) AS first_us FROM m WHERE epoch > (SELECT min(epoch) FROM m)")
def epoch_marks(spark, sf):
    m = M.as_of_epochs(_s(spark, sf).select("event_id", "ts"), _epochs(spark, sf)).where("epoch is not null").groupBy("epoch").agg(F.min(F.unix_micros("ts")).alias("first_us"))
    return m.withColumn("least", F.min("epoch").over(Window.partitionBy())).where("epoch > least").select("epoch", "first_us")


_BANDS = "bands AS (SELECT t_s AS t0, 43200 AS dur FROM tl WHERE failed = (SELECT max(failed) FROM tl))"


def _bands(tl):
    """Half a day from each of the windows with most failures."""
    most = tl.agg(F.max("failed").alias("most"))
    return tl.join(F.broadcast(most), F.col("failed") == F.col("most")).select(F.col("t_s").alias("t0"), F.lit(43200).alias("dur"))


@query("J16_band_join", f"WITH {_T}, {_BANDS} SELECT t0, t_s AS t, p99_us FROM tl JOIN bands ON t_s >= t0 AND t_s <= t0 + dur + 1")
def band_join(spark, sf):
    tl = timeline(spark, sf)
    return M.in_bands(tl.withColumn("t", F.col("t_s")), _bands(tl)).select("t0", "t", "p99_us")


@query("T7_transition_cost", f"WITH {_T}, {_BANDS}, d AS (SELECT p99_us FROM tl JOIN bands ON t_s >= t0 AND t_s <= t0 + dur + 1 WHERE p99_us > 0), bf AS (SELECT list_sort(list(p99_us)) AS l FROM tl WHERE p99_us > 0 AND t_s < (SELECT min(t0) FROM bands)) SELECT (SELECT max(p99_us) FROM d) AS during_us, l[CAST(least(len(l) - 1, floor(0.99 * len(l))) AS BIGINT) + 1] AS before_us FROM bf")
def transition_cost(spark, sf):
    tl = timeline(spark, sf)
    b = _bands(tl)
    during = M.in_bands(tl.withColumn("t", F.col("t_s")), b).where("p99_us > 0").agg(F.max("p99_us").alias("during_us"))
    start = b.agg(F.min("t0").alias("first"))
    before = M.rank_quantiles(tl.join(F.broadcast(start)).where("p99_us > 0 and t_s < first").withColumn("one", F.lit(1)), ["one"], "p99_us", {"before_us": 0.99})
    return during.join(before.drop("one"), F.lit(True), "left")


@query("W8_counter_deltas", f"WITH {S}, n AS (SELECT node, CAST(date_trunc('day', ts) AS DATE) AS d, count(*) AS c FROM s GROUP BY ALL), t AS (SELECT node, d, CAST(sum(c) OVER (PARTITION BY node ORDER BY d) AS BIGINT) AS total FROM n) SELECT node, CAST(d AS VARCHAR) AS d, total, total - lag(total) OVER (PARTITION BY node ORDER BY d) AS delta FROM t")
def counter_deltas(spark, sf):
    n = _s(spark, sf).groupBy("node", F.to_date("ts").alias("d")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("node").orderBy("d")
    t = n.withColumn("total", F.sum("c").over(w))
    return t.select("node", F.col("d").cast("string").alias("d"), "total", (F.col("total") - F.lag("total").over(w)).alias("delta"))


@query("W4_running_offsets", f"WITH {S}, n AS (SELECT node, count(*) AS size FROM s GROUP BY node) SELECT node, size, CAST(coalesce(sum(size) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM n")
def running_offsets(spark, sf):
    n = _s(spark, sf).groupBy("node").agg(F.count("*").alias("size"))
    return prefix_sums(n, [F.col("node")], F.col("size"), "start")


@query("A10_rates", f"WITH {S}, n AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS w, type, us FROM s) SELECT CAST(epoch(w) AS BIGINT) AS w, type, round(count(*) / 86400.0::DOUBLE, 9) AS per_s, round(CAST(sum(us) AS DOUBLE) / count(us), 6) AS mean_us, {_q(0.5)} AS p50_us, max(us) AS top_us FROM n GROUP BY w, type")
def rates(spark, sf):
    """Rate, mean and quantiles of a day and type."""
    s = _s(spark, sf).withColumn("w", F.unix_timestamp(F.date_trunc("day", "ts")))
    q = M.rank_quantiles(s, ["w", "type"], "us", {"p50_us": 0.5, "top_us": 1.0})
    n = s.groupBy("w", "type").agg(F.round(F.count("*") / F.lit(86400.0), 9).alias("per_s"), F.round(F.sum("us").cast("double") / F.count("us"), 6).alias("mean_us"))
    return n.join(q, ["w", "type"]).select("w", "type", "per_s", "mean_us", "p50_us", "top_us")


_R = f"""WITH {S}, d AS (SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS w, * FROM s),
h AS (SELECT w, type, {_B} AS bucket, count(*) AS n FROM d WHERE us IS NOT NULL GROUP BY ALL),
c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY w, type ORDER BY bucket) AS BIGINT) AS upto, CAST(sum(n) OVER (PARTITION BY w, type) AS BIGINT) AS of FROM h),
p AS (SELECT w, type, min(bucket) FILTER (WHERE upto >= ceil(0.5::DOUBLE * of)) AS p50, min(bucket) FILTER (WHERE upto >= ceil(0.99::DOUBLE * of)) AS p99, min(bucket) FILTER (WHERE upto >= ceil(0.999::DOUBLE * of)) AS p999 FROM c GROUP BY w, type),
a AS (SELECT w, type, count(us) AS n, count(*) AS rows, CAST(sum(us) AS DOUBLE) AS total_us, CAST(max(us) AS DOUBLE) AS top, max({{'t': ts, 'e': event_id, 'u': us}}).u AS last FROM d GROUP BY w, type),
r AS (SELECT a.*, p50, p99, p999, CAST(sum(rows) OVER (PARTITION BY type ORDER BY w) AS BIGINT) AS total FROM a LEFT JOIN p USING (w, type))"""
_EDGE = "CASE WHEN {0} >= 379 THEN top ELSE least(pow(1.05::DOUBLE, {0}), top) END"
_REPORT = [("latency", ".count", "n", ""), ("latency", ".per_sec", "n / 86400.0::DOUBLE", ""), ("queries", "", "total", ""), ("queries", ".per_sec", "rows / 86400.0::DOUBLE", ""), ("latency", ".last_us", "last", "")] + [
    ("latency", name, value, " WHERE n > 0") for name, value in ((".mean_us", "total_us / n"), (".p50_us", _EDGE.format("p50")), (".p99_us", _EDGE.format("p99")), (".p999_us", _EDGE.format("p999")), (".max_us", "top"))
]


@query("A10_registry", _R + "\n" + "\nUNION ALL ".join(f"SELECT w, '{kind}.' || type || '{name}' AS type, round(CAST({value} AS DOUBLE), 6) AS value FROM r{where}" for kind, name, value, where in _REPORT))
def registry(spark, sf):
    return M.registry(_s(spark, sf)).select(F.unix_timestamp("w").alias("w"), "type", F.round("value", 6).alias("value"))


@query("T6_event_rows", f"WITH {_E} SELECT epoch_us(ts) AS at, node, 'latency.' || type AS type, CAST(us AS DOUBLE) AS value FROM s UNION ALL SELECT epoch_us(ts), 0, 'epoch', CAST(epoch AS DOUBLE) FROM e")
def event_rows(spark, sf):
    """Latencies and installed epochs in one table of samples."""
    changes = _epochs(spark, sf).select("ts", F.lit(0).cast("long").alias("node"), F.lit("epoch").alias("type"), F.col("epoch").alias("value"))
    return M.with_changes(_s(spark, sf), changes).select(F.unix_micros("ts").alias("at"), "node", "type", "value")


@query("T3_retries", f"WITH {S} SELECT event_id, CAST(us % 7 + CASE WHEN event_id % 9 = 0 THEN 20 WHEN event_id % 3 = 0 THEN 8 ELSE 0 END AS DOUBLE) AS latency_ms, 'ok' AS status, CAST(CASE WHEN event_id % 9 = 0 THEN 3 WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempts FROM s WHERE us IS NOT NULL")
def retries(spark, sf):
    """Every third event finds its node unavailable, every ninth twice."""
    from spindrift.streaming.arrivals import with_retries

    t = lambda ms, busy: F.struct(ms.cast("double").alias("ms"), F.when(busy, "unavailable").otherwise("ok").alias("status"))
    tries = F.array(t(F.col("us") % 7, F.col("event_id") % 3 == 0), t(F.lit(3), F.col("event_id") % 9 == 0), t(F.lit(2), F.lit(False)))
    a = _s(spark, sf).where("us is not null").select(F.col("event_id").alias("qid"), F.lit(0.0).alias("sched_ms"), tries.alias("tries"))
    return with_retries(a).select(F.col("qid").alias("event_id"), "latency_ms", "status", "attempts")


@query("J11_absent_stream", "SELECT DISTINCT user_id AS loc, user_id * 2 AS data FROM events")
def absent_stream(spark, sf):
    """A stream of locations to a table that takes each once, however often it comes."""
    from spindrift.folders import shared
    from spindrift.streaming.reports import sample_stream, stream_absent

    where = shared(spark, "absent")
    rows = sample_stream(spark, f"{sf}/events.parquet").select(F.col("node").alias("loc"), (F.col("node") * 2).alias("data"))
    stream_absent(rows, f"{where}/table", f"{where}/state", 64).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{where}/table").select("loc", "data")


@query("T9_bounded_batches", "SELECT user_id AS loc, count(*) AS events, user_id * 2 AS data, true AS bounded FROM events GROUP BY user_id")
def bounded_batches(spark, sf):
    """The events as batches of at most a fifth of their rows, each adding what is still absent; and whether every batch kept the bound."""
    from spindrift.folders import shared
    from spindrift.sources.event_log import stream
    from spindrift.streaming.reports import absent_batch

    where, n = shared(spark, "bounded"), spark.read.parquet(f"{sf}/events.parquet").count()
    most = -(-n // 5)

    def batch(df, number):
        df.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{where}/seen")
        absent_batch(df.select(F.col("user_id").alias("loc"), (F.col("user_id") * 2).alias("data")), f"{where}/table")

    rows = stream(spark, f"{sf}/events.parquet", f"{where}/position", most, "user_id long")
    q = rows.writeStream.foreachBatch(batch).option("checkpointLocation", f"{where}/state").start()
    q.processAllAvailable()
    q.stop()
    seen = spark.read.schema("user_id long, n long, batch int").parquet(f"{where}/seen")
    worst = seen.groupBy("batch").agg(F.sum("n").alias("n")).agg((F.max("n") <= most).alias("bounded"))
    per = seen.groupBy(F.col("user_id").alias("loc")).agg(F.sum("n").alias("events"))
    return per.join(spark.read.parquet(f"{where}/table"), "loc").join(worst).select("loc", "events", "data", "bounded")


@query("W6_id_runs", f"WITH {S} SELECT type, min(event_id) AS lo, max(event_id) AS hi, count(*) AS n FROM (SELECT type, event_id, event_id - row_number() OVER (PARTITION BY type ORDER BY event_id) AS g FROM s) GROUP BY type, g")
def id_runs(spark, sf):
    return runs(_s(spark, sf), "type", "event_id", 1 << 16)


@query("W9_round_robin", f"WITH {S} SELECT event_id, CAST((3 + row_number() OVER (PARTITION BY node ORDER BY event_id) - 1) % 5 AS INTEGER) AS source FROM s")
def round_robin(spark, sf):
    k = F.row_number().over(Window.partitionBy("node").orderBy("event_id"))
    return _s(spark, sf).select("event_id", ((k + 2) % 5).cast("int").alias("source"))


@query("M18_entry_batches", f"WITH {S} SELECT epoch(time_bucket(INTERVAL '6 hours', ts))::BIGINT AS flip_s, count(DISTINCT node) AS entries FROM s WHERE type = 'signup' GROUP BY 1")
def entry_batches(spark, sf):
    """Nodes that became ready, promoted once per interval."""
    w = _s(spark, sf).where("type = 'signup'").groupBy(F.window("ts", "6 hours").alias("w")).agg(F.countDistinct("node").alias("entries"))
    return w.select(F.unix_timestamp("w.start").alias("flip_s"), "entries")


@query("P14_status_category", f"WITH {S} SELECT event_id, CASE type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'ok' WHEN 'click' THEN 'ok' ELSE 'other' END AS category FROM s")
def status_category(spark, sf):
    c = F.when(F.col("type") == "error", "failed").when(F.col("type").isin("view", "click"), "ok").otherwise("other")
    return _s(spark, sf).select("event_id", c.alias("category"))


@query("P7_tie_hash", "SELECT event_id, CAST(((event_id * 2654435761) % 4294967296) // 65536 % 3 AS INTEGER) AS owner FROM events")
def tie_hash(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.expr("cast((((event_id * 2654435761L) % 4294967296L) div 65536) % 3 as int)").alias("owner"))


@query("P13_parse_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parse_props(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("S20_finite_samples", f"WITH {S} SELECT type, count(*) AS n FROM s WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value) GROUP BY type")
def finite_samples(spark, sf):
    from spindrift.sources.metric_files import finite

    return finite(_s(spark, sf)).groupBy("type").agg(F.count("*").alias("n"))


@query("T8_in_flight", f"WITH {S}, e AS (SELECT node, epoch_us(ts) AS t, 1 AS d FROM s UNION ALL SELECT node, epoch_us(ts) + us AS t, -1 AS d FROM s), g AS (SELECT node, t, sum(d) AS d FROM e GROUP BY node, t), r AS (SELECT node, sum(d) OVER (PARTITION BY node ORDER BY t) AS n FROM g) SELECT node, CAST(max(n) AS BIGINT) AS most FROM r GROUP BY node")
def in_flight(spark, sf):
    s = _s(spark, sf)
    at = F.unix_micros("ts")
    e = s.select("node", at.alias("at"), F.lit(1).alias("d")).unionByName(s.select("node", (at + F.col("us")).alias("at"), F.lit(-1).alias("d")))
    g = e.groupBy("node", "at").agg(F.sum("d").alias("d"))
    r = g.withColumn("n", F.sum("d").over(Window.partitionBy("node").orderBy("at")))
    return r.groupBy("node").agg(F.max("n").alias("most"))


@query("T1_arrivals", """WITH p AS (SELECT slice, CASE WHEN slice < 10 THEN 50.0::DOUBLE ELSE 200.0::DOUBLE END AS rate, unnest(range(1, CASE WHEN slice < 10 THEN 176 ELSE 411 END)) AS i FROM (SELECT unnest(range(20)) AS slice)),
g AS (SELECT slice, i, rate, -ln(1 - CAST(CAST('0x' || substr(md5('42/' || slice || '/0/' || i), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE) AS gap FROM p),
t AS (SELECT slice, slice + sum(gap) OVER (PARTITION BY slice ORDER BY i) / rate AS sched FROM g)
SELECT round(sched, 6) AS sched, (row_number() OVER (ORDER BY slice, sched) - 1) % 100 AS qid FROM t WHERE sched < slice + 1""")
def arrivals(spark, sf):
    from spindrift.streaming.arrivals import poisson

    return poisson(spark, [(0.0, 50.0), (10.0, 200.0)], 20.0, 100).select(F.round("sched", 6).alias("sched"), "qid")


@query("T5_stream_reports", f"WITH {S} SELECT epoch(date_trunc('day', ts))::BIGINT AS w, type, count(*) AS n, CAST(sum(us) AS BIGINT) AS busy_us FROM s GROUP BY ALL")
def stream_reports(spark, sf):
    from spindrift.streaming.reports import drained

    return drained(spark, f"{sf}/events.parquet").select("w", "type", "n", "busy_us")
