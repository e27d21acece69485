"""Open-loop arrivals, and latencies from scheduled time with retries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.operators.ranking import prefix_sums
from spindrift.undecided import Undecided


def parse_steps(text: str) -> list[tuple[float, float]]:
    """"30:400,90:800" to [(offset, rate)]; offsets must increase."""
    steps = [(float(a), float(b)) for a, b in (x.split(":") for x in text.split(",") if x)]
    if not steps or any(b[0] <= a[0] for a, b in zip(steps, steps[1:])) or any(r < 0 for _, r in steps):
        raise ValueError(f"steps must have increasing offsets and rates: {text}")
    return steps


def poisson(spark: SparkSession, steps: list[tuple[float, float]], until: float, queries: int, seed: int = 42, slice_s: float = 1.0) -> DataFrame:
    """sched (seconds), qid: a Poisson process whose rate follows the steps, queries in turn.

    A Poisson process restarts at any time, so time is cut into slices, and these at the steps' offsets; a rate of 0 pauses. Gaps
    are exponential, from the md5 of seed, slice, piece and number, so a task that runs again draws the same. A piece that expects
    x arrivals is given x + 12 sqrt(x) + 40 gaps; should they end before the piece (odds below 1e-20), the job fails."""
    n = max(1, math.ceil(until / slice_s))
    known = F.array(*[F.struct(F.lit(float(o)).alias("o"), F.lit(float(r)).alias("r")) for o, r in steps])
    s = spark.range(n).select(F.col("id").alias("slice"), (F.col("id") * F.lit(float(slice_s))).alias("at"), F.least(F.lit(float(until)), (F.col("id") + 1) * F.lit(float(slice_s))).alias("end"))
    cuts = F.filter(F.transform(known, lambda x: x["o"]), lambda o: (o > F.col("at")) & (o < F.col("end")))
    s = s.select("slice", F.array_sort(F.concat(F.array("at", "end"), cuts)).alias("e"))
    s = s.select("slice", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("e") - 2), lambda i: F.struct(F.get("e", i).alias("a"), F.get("e", i + 1).alias("b")))).alias("piece", "x")).select("slice", "piece", "x.a", "x.b")
    s = s.withColumn("rate", F.coalesce(F.get(F.reverse(F.filter(known, lambda x: x["o"] <= F.col("a"))), F.lit(0))["r"], F.lit(0.0))).where("rate > 0 and a < b")
    x = F.col("rate") * (F.col("b") - F.col("a"))
    s = s.withColumn("most", F.ceil(x + 12 * F.sqrt(x) + 40)).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "most")))
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("slice").cast("string"), F.col("piece").cast("string"), F.col("i").cast("string")))
    gap = -F.ln(1 - F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0**52))
    s = s.withColumn("sched", F.col("a") + F.sum(gap).over(Window.partitionBy("slice", "piece").orderBy("i")) / F.col("rate"))
    short = (F.col("i") == F.col("most")) & (F.col("sched") < F.col("b"))
    per = s.where(F.when(short, F.raise_error(F.lit("too few gaps were drawn")).cast("boolean")).otherwise(F.col("sched") < F.col("b"))).select("slice", "sched")
    counts = prefix_sums(per.groupBy("slice").agg(F.count("*").alias("c")), [F.col("slice")], F.col("c"), "before")
    rank = F.row_number().over(Window.partitionBy("slice").orderBy("sched")) - 1
    return per.withColumn("r", rank).join(counts, "slice").select("sched", ((F.col("before") + F.col("r")) % queries).alias("qid"))


def self_similar(*_):
    raise Undecided("U11")


def with_retries(attempts: DataFrame, most: int = 3, wait_ms: int = 5) -> DataFrame:
    """attempts: qid, sched_ms, tries (array of (ms, status)); latency counts from the schedule, an unavailable node is tried
    again after wait_ms * (number of the try), up to `most` times."""
    used = F.slice("tries", 1, most)
    ends = F.aggregate(used, F.struct(F.lit(0.0).alias("ms"), F.lit("unavailable").alias("status"), F.lit(0).alias("n")), lambda a, t: F.when(
        a["status"] == "unavailable",
        F.struct((a["ms"] + F.when(a["n"] > 0, F.lit(float(wait_ms)) * a["n"]).otherwise(0.0) + t["ms"]).alias("ms"), t["status"].alias("status"), (a["n"] + 1).alias("n")),
    ).otherwise(a))
    return attempts.withColumn("e", ends).select("qid", "sched_ms", F.col("e.ms").alias("latency_ms"), F.col("e.status").alias("status"), F.col("e.n").alias("attempts"))
