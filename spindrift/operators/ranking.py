"""Global row numbers and running sums without a window that gathers the table in one task."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges are found by two levels of so many borders; rows of a range, until there are FAN * FAN of them.
FAN, RANGE = 64, 1 << 16


def borders(df: DataFrame, key: str, parts: int) -> list:
    """At most parts - 1 keys that split df about evenly, from a sample by hash of about 20 keys a part (for balance only)."""
    every = max(1, df.count() // (20 * parts))
    seen = df.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).select(key).distinct().orderBy(key).collect()
    return [seen[i * len(seen) // parts][0] for i in range(1, parts)] if len(seen) >= parts else []


def prefix_sums(df: DataFrame, order: list[Column], value: Column, name: str, parts: int | None = None) -> DataFrame:
    """Adds name: the sum of value (a long) over all rows before this one (0 for the first). The order is ascending, nulls first.

    Rows are dealt over ranges of the order, whose borders are literals (so that a recomputed task deals alike), and summed
    inside each; the driver gets one number a range. Rows equal in order are in one range, in any order."""
    parts = parts or min(FAN * FAN, max(min(FAN, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), df.count() // RANGE))
    d = df.withColumn("__key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])).withColumn("__value", value.cast("long"))
    kind = d.schema["__key"].dataType.simpleString()
    cut = [F.struct(*[F.lit(x).alias(f"k{i}") for i, x in enumerate(row)]).cast(kind) for row in borders(d, "__key", parts)]
    d = d.withColumn("__range", _place(cut))
    sums = {r["__range"]: r["s"] or 0 for r in d.groupBy("__range").agg(F.sum("__value").alias("s")).collect()}
    starts = list(itertools.accumulate([sums.get(i, 0) for i in range(len(cut) + 1)], initial=0))[:-1]
    inside = F.coalesce(F.sum("__value").over(Window.partitionBy("__range").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn(name, (F.get(F.lit(starts), F.col("__range")) + inside).cast("long")).drop("__key", "__value", "__range")


def _place(cut: list[Column]) -> Column:
    """How many of the ascending borders are at or below the row's key, found in two levels: FAN comparisons each at most."""
    if not cut:
        return F.lit(0)
    below = lambda borders: F.size(F.filter(borders, lambda b: b <= F.col("__key")))
    if len(cut) <= FAN:
        return below(F.array(*cut))
    groups = [cut[i : i + FAN] for i in range(0, len(cut), FAN)]
    n = below(F.array(*[g[0] for g in groups]))
    return F.when(n == 0, 0).otherwise((n - 1) * FAN + below(F.get(F.array(*[F.array(*g) for g in groups]), n - 1)))


def numbered(df: DataFrame, order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """Adds name: the row's number from 1 on, over all rows."""
    return prefix_sums(df, order, F.lit(1), name, parts).withColumn(name, F.col(name) + 1)


def runs(df: DataFrame, key: str, ident: str, width: int = 1 << 20) -> DataFrame:
    """key, lo, hi, n: runs of consecutive ids of each key. An id that repeats within its key belongs to one run, counted as often.

    Ids are dealt over stretches of `width`; only the runs that touch a stretch's border, two at most per key and stretch, are then
    joined over a window of the key."""
    one = df.where(F.col(ident).isNotNull()).groupBy(key, ident).agg(F.count("*").alias("n"))
    one = one.withColumn("part", F.floor(F.col(ident) / F.lit(width)))
    w = Window.partitionBy(key, "part").orderBy(ident)
    r = one.withColumn("g", F.col(ident) - F.row_number().over(w)).groupBy(key, "part", "g").agg(F.min(ident).alias("lo"), F.max(ident).alias("hi"), F.sum("n").alias("n"))
    edge = (F.col("lo") == F.col("part") * width) | (F.col("hi") == (F.col("part") + 1) * width - 1)
    r = r.withColumn("edge", edge)
    by = Window.partitionBy(key).orderBy("lo")
    e = r.where("edge").withColumn("first", (F.coalesce(F.lag("hi").over(by), F.col("lo")) != F.col("lo") - 1).cast("int"))
    e = e.withColumn("run", F.sum("first").over(by)).groupBy(key, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    return r.where("not edge").select(key, "lo", "hi", "n").unionByName(e.select(key, "lo", "hi", "n"))
