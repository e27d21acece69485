"""Analytics of metric samples and per-query latencies: nearest-rank quantiles, log histograms, timelines, as-of epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.vectors import log_bucket


def samples(events: DataFrame) -> DataFrame:
    """Events as metric samples: ts, node, type, value, us (whole microseconds), status."""
    us = F.floor(F.col("value") * 1000).cast("long")
    return events.where("ts is not null").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("node"), F.col("event_type").alias("type"), "value", us.alias("us"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))


def rank_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Nearest-rank by index: the value at min(n - 1, floor(q * n)), exact. No task orders a group's values.

    Equal values are counted first (per task, then globally). Values are then counted by bucket (1,024 a doubling, so some tens of thousands a
    group at most, whatever its size); running sums over buckets name the one that holds each rank, and only that bucket's distinct values are
    ordered. Null keys are a group."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    whole = F.floor(F.col(value)).cast("double")
    size = F.floor(F.log2(F.greatest(F.abs(whole), F.lit(1.0))) * 1024).cast("int") + 1
    n = n.withColumn("__b", F.when(whole > 0, size).when(whole < 0, -size).otherwise(0))
    w = Window.partitionBy(*keys)
    per = n.groupBy(*keys, "__b").agg(F.sum("__c").alias("__c")).withColumn("__upto", F.sum("__c").over(w.orderBy("__b"))).withColumn("__n", F.sum("__c").over(w))
    rank = lambda q: F.least(F.col("__n") - 1, F.floor(F.lit(q) * F.col("__n"))).cast("long")
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(q).alias("rank")) for name, q in quantiles.items()])).alias("__q")
    held = per.select(*keys, "__b", "__c", "__upto", asked).where((F.col("__q.rank") < F.col("__upto")) & (F.col("__q.rank") >= F.col("__upto") - F.col("__c")))
    held = held.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__b").alias("__at"), F.col("__q.name").alias("__name"), (F.col("__q.rank") - F.col("__upto") + F.col("__c")).alias("__left"))
    same = F.col("__b") == F.col("__at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    v = n.join(held, same)
    v = v.withColumn("__upto", F.sum("__c").over(Window.partitionBy(*keys, "__b", "__name").orderBy(value))).where(F.col("__upto") > F.col("__left"))
    return v.groupBy(*keys).agg(*[F.min(F.when(F.col("__name") == name, F.col(value))).alias(name) for name in quantiles])


def histogram(df: DataFrame, keys: list[str], us: str = "us") -> DataFrame:
    """keys, bucket, n."""
    return df.where(F.col(us).isNotNull()).groupBy(*keys, log_bucket(F.col(us).cast("double")).alias("bucket")).agg(F.count("*").alias("n"))


def histogram_quantiles(df: DataFrame, keys: list[str], quantiles: dict[str, float], us: str = "us", overflow: int = 379) -> DataFrame:
    """count and, for each quantile, the bucket that holds rank ceil(q * n) (its edge is 1.05^bucket, at most the maximum)."""
    h = histogram(df, keys, us)
    w = Window.partitionBy(*keys)
    h = h.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    aggs = [F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("total")), F.col("bucket"))).alias(name) for name, q in quantiles.items()]
    return h.groupBy(*keys).agg(F.sum("n").alias("n"), *aggs)


def timeline(df: DataFrame, width: int) -> DataFrame:
    """w (window number from the first sample), t_s, offered, answered, failed, p50_us, p99_us; windows without samples too.

    The last sample's window is the last one."""
    first = df.agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    micros = F.unix_micros("ts") - F.unix_micros("t0")
    span = F.unix_micros("t1") - F.unix_micros("t0")
    count = F.greatest(F.lit(1).cast("long"), F.ceil((span.cast("double") / 1e6 + 1e-9) / width).cast("long"))
    rows = df.join(F.broadcast(first)).withColumn("w", F.least(count - 1, F.floor(micros.cast("double") / 1e6 / width).cast("long")))
    spine = first.where("t0 is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("w"))
    n = rows.groupBy("w").agg(F.count("*").alias("offered"), F.count_if(F.col("status") == "ok").alias("answered"), F.count_if(F.col("status") != "ok").alias("failed"))
    q = rank_quantiles(rows.where("status = 'ok'"), ["w"], "us", {"p50_us": 0.5, "p99_us": 0.99})
    out = spine.join(n, "w", "left").join(q, "w", "left").fillna(0, ["offered", "answered", "failed"])
    return out.select("w", (F.col("w") * width).alias("t_s"), "offered", "answered", "failed", "p50_us", "p99_us")


def as_of_epochs(queries: DataFrame, epochs: DataFrame) -> DataFrame:
    """Adds the latest epoch installed at or before a query's ts. queries: event_id, ts; epochs: epoch, ts.

    Epochs and queries are merged per day and ordered; a day starts from the latest epoch of the days before it, so no task
    sorts all queries."""
    day = F.to_date("ts")
    e = epochs.withColumn("day", day)
    before = e.groupBy("day").agg(F.max(F.struct("ts", "epoch")).alias("last"))
    days = queries.select(day.alias("day")).union(e.select("day")).distinct()
    carry = days.join(before, "day", "left").withColumn("carry", F.last("last.epoch", True).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))).select("day", "carry")
    both = e.select("day", "ts", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("event_id"), "epoch").unionByName(queries.select(day.alias("day"), "ts", F.lit(1).alias("kind"), "event_id", F.lit(None).cast("long").alias("epoch")))
    w = Window.partitionBy("day").orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("epoch", F.last("epoch", True).over(w)).where("kind = 1")
    return found.join(F.broadcast(carry), "day").select("event_id", "ts", F.coalesce("epoch", "carry").alias("epoch"))


def snapshots(df: DataFrame, width: str = "1 day") -> DataFrame:
    """Registry samples per window and type: name, w, value in long form: count, total (running) and its delta."""
    n = df.groupBy(F.window("ts", width).alias("win"), "type").agg(F.count("*").alias("count"), F.sum("us").alias("sum_us"))
    w = Window.partitionBy("type").orderBy("win")
    n = n.withColumn("total", F.sum("count").over(w)).withColumn("delta", F.col("total") - F.coalesce(F.lag("total").over(w), F.lit(0)))
    n = n.select(F.col("win.start").alias("w"), "type", "count", "total", "delta", "sum_us")
    return n.select("w", "type", F.expr("stack(4, 'count', count, 'total', total, 'delta', delta, 'sum_us', sum_us) as (metric, value)"))


def registry(df: DataFrame, seconds: int = 86400) -> DataFrame:
    """w (start of the interval), type, value: the samples that a registry reports per interval, in long form.

    Of each kind of query its latency histogram (count, per_sec, and if there are any mean_us, p50_us, p99_us, p999_us, max_us; a quantile is the
    edge of its bucket, the maximum at most), a counter that goes on (total, per_sec of its growth), and a gauge: the latest latency.
    A task reduces its rows to buckets, of which there are 380 at most per interval and kind."""
    us, by = F.col("us"), ["win", "type"]
    one = F.struct("ts", "event_id", "us")
    b = df.groupBy(F.window("ts", f"{seconds} seconds").alias("win"), "type", F.when(us.isNotNull(), log_bucket(us.cast("double"))).alias("bucket"))
    b = b.agg(F.count("us").alias("n"), F.count("*").alias("rows"), F.sum("us").alias("sum"), F.max("us").alias("max"), F.max(one).alias("last"))
    w = Window.partitionBy(*by)
    b = b.withColumn("upto", F.sum("n").over(w.orderBy(F.col("bucket").asc_nulls_last()))).withColumn("of", F.sum("n").over(w))
    at = lambda q, name: F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("of")), F.col("bucket"))).alias(name)
    g = b.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"), F.sum("sum").alias("sum"), F.max("max").alias("max"), F.max("last").alias("last"), at(0.5, "p50"), at(0.99, "p99"), at(0.999, "p999"))
    g = g.withColumn("total", F.sum("rows").over(Window.partitionBy("type").orderBy("win")))
    edge = lambda c: F.when(F.col(c) >= 379, F.col("max").cast("double")).otherwise(F.least(F.pow(F.lit(1.05), F.col(c)), F.col("max").cast("double")))
    named = lambda name, value: F.struct(F.concat(F.lit("latency."), "type", F.lit(name)).alias("type"), value.cast("double").alias("value"))
    counted = lambda name, value: F.struct(F.concat(F.lit("queries."), "type", F.lit(name)).alias("type"), value.cast("double").alias("value"))
    if_any = [named(".mean_us", F.col("sum") / F.col("n")), named(".p50_us", edge("p50")), named(".p99_us", edge("p99")), named(".p999_us", edge("p999")), named(".max_us", F.col("max"))]
    every = [named(".count", F.col("n")), named(".per_sec", F.col("n") / F.lit(float(seconds))), counted("", F.col("total")), counted(".per_sec", F.col("rows") / F.lit(float(seconds))), named(".last_us", F.col("last.us"))]
    out = g.select("win", F.explode(F.concat(F.array(*every), F.when(F.col("n") > 0, F.array(*if_any)).otherwise(F.array()))).alias("x"))
    return out.select(F.col("win.start").alias("w"), "x.type", "x.value")


def with_changes(df: DataFrame, changes: DataFrame) -> DataFrame:
    """ts, node, type, value: latencies and reconfiguration events (ts, node, type, value) as rows of one table."""
    return df.select("ts", "node", F.concat(F.lit("latency."), "type").alias("type"), F.col("us").cast("double").alias("value")).unionByName(changes.select("ts", "node", "type", F.col("value").cast("double").alias("value")))


def saturation(steps: DataFrame) -> DataFrame:
    """Greatest offered rate that was answered to 95 % without a failure."""
    return steps.where((F.col("answered") * 100 >= F.col("offered") * 95) & (F.col("failed") == 0)).agg(F.max("offered").alias("saturation"))


def in_bands(points: DataFrame, bands: DataFrame, slack: int = 1) -> DataFrame:
    """Points whose t lies in [t0, t0 + dur + slack] of a band (whole numbers).

    A range join by equality: bands of about one length (a power of two) are cut by bins of that length, two bins each at most; a point
    looks in its bin of each length there is."""
    end = F.col("t0") + F.col("dur") + slack
    b = bands.withColumn("__end", end.cast("long")).where(F.col("__end") >= F.col("t0"))
    b = b.withColumn("__k", F.ceil(F.log2((F.col("__end") - F.col("t0") + 1).cast("double"))).cast("int"))
    kinds = [r[0] for r in b.select("__k").distinct().collect()]  # 64 at most
    bins = lambda c: F.array(*[F.struct(F.lit(k).alias("__k"), F.shiftright(F.floor(c).cast("long"), k).alias("__bin")) for k in kinds])
    if not kinds:
        return points.join(bands, F.lit(False))
    lo, hi = (F.expr(f"element_at(map({', '.join(f'{k}, shiftright(cast({c} as bigint), {k})' for k in kinds)}), __k)") for c in ("t0", "__end"))
    b = b.withColumn("__bin", F.explode(F.sequence(lo, hi)))
    p = points.withColumn("__x", F.explode(bins(F.col("t")))).withColumn("__pk", F.col("__x.__k")).withColumn("__pbin", F.col("__x.__bin")).drop("__x")
    met = p.join(b, (F.col("__pk") == F.col("__k")) & (F.col("__pbin") == F.col("__bin")) & (F.col("t") >= F.col("t0")) & (F.col("t") <= F.col("__end")))
    return met.select(*points.columns, *bands.columns)
