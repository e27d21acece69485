"""Mixing sources to target weights by entropy balancing.

The rates r_d that stay closest to 1 (in relative entropy, weighted by size) while every category's
sum of size * rate meets its target have the form r_d = exp(sum of the duals of d's categories). The
duals minimise a convex function; Newton's method on it needs only sums over the rows, which Spark
computes, so a step costs one aggregate. Rates become whole copies by carrying what rounding leaves over.

For one family of categories (the registered query) the Hessian is diagonal: every Newton step is one aggregate over
the cells (source, size) and a table of duals, and nothing but the largest error comes to the driver. Several
families at once are solved by balance().

Defined cases: a null text has size 0; a null source is a source of its own, placed last; rows repeated in full are
separate rows: they are ranked side by side, and which of them has a copy more makes no difference; rows that share
doc_id, source and size but not text are told apart by the text's hash; empty tables give empty results; a source of
size 0 has target 0. Only doc_id, source and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.ranking import numbered

from .common import WORD, discard, small_batches, staged

NEWTON_STEPS = 200
#: Rows of one source and size that are ranked in one task, about, if they are a third of all rows.
RANKED = 20_000


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text), th (hash of the text)."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("th"))


def weighted_targets(totals: DataFrame, weights=(5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """Adds target to (source, source_size): all of the size, shared by weight, at most `most` times a source's size.

    Sources in code-point order (null last) take the weights in turn. What a cap leaves over is shared again by weight,
    until no source is above its cap: each round is one aggregate over the sources, and caps only ever join."""
    t = numbered(totals, [F.col("source").isNull(), F.col("source")], "turn")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("turn") - 1) % len(weights) + 1).cast("int"))
    t = staged(t.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size")).drop("turn"), "sources")
    level, capped = float("-inf"), -1
    while True:
        held = F.col("cap") < F.lit(level) * F.col("w")
        r = t.agg(F.sum("source_size").alias("all"), F.sum(F.when(held, F.col("cap"))).alias("caps"), F.sum(F.when(~held, F.col("w"))).alias("w"), F.count_if(held).alias("n")).first()
        if r["n"] == capped or not r["w"]:
            break
        level, capped = (float(r["all"]) - (r["caps"] or 0.0)) / r["w"], r["n"]
    return t.select("source", "source_size", F.least(F.col("cap"), F.lit(max(level, 0.0)) * F.col("w")).alias("target"))


def balance_one(cells: DataFrame, targets: DataFrame, mass: str = "mass", steps: int = NEWTON_STEPS, tol: float = 1e-10) -> DataFrame:
    """Newton on the dual when each cell belongs to one source. cells: (source, mass), any number of cells a source;
    targets: (source, source_size, target). Adds dual and rate = exp(dual) (null and 0 where the target or the mass is 0).

    The gradient of source s is its tilted mass less its target, the Hessian's diagonal the tilted mass itself. Stops when
    no source is off by more than tol of its target; raises if that takes more than `steps` steps."""
    live = (F.col("target") > 0) & (F.col("source_size") > 0)
    duals = staged(targets.withColumn("dual", F.when(live, F.lit(0.0))), "duals")
    cells = cells.select(F.col("source").alias("__s"), F.col(mass).cast("double").alias("__m"))
    for _ in range(steps):
        rated = cells.join(duals, F.col("source").eqNullSafe(F.col("__s"))).where("dual is not null")
        tilted = rated.groupBy("__s").agg(F.sum(F.col("__m") * F.exp("dual")).alias("__t"))
        moved = duals.join(tilted, F.col("source").eqNullSafe(F.col("__s")), "left")
        off = F.abs(F.col("__t") - F.col("target")) / F.col("target")
        now = staged(moved.select("source", "source_size", "target", (F.col("dual") - (F.col("__t") - F.col("target")) / F.col("__t")).alias("dual"), off.alias("off")), "duals")
        discard(duals)
        duals = now
        if (duals.agg(F.max("off")).first()[0] or 0.0) <= tol:
            return duals.select("source", "source_size", "target", "dual", F.coalesce(F.exp("dual"), F.lit(0.0)).alias("rate"))
    raise ArithmeticError(f"no balance after {steps} steps")


def balance(docs: DataFrame, size: str, families: dict[str, dict], max_duals: int = 2000, steps: int = 50, tol: float = 1e-9) -> dict[str, dict]:
    """Newton for several families of categories at once: {column: {category: target}} to {column: {category: dual}}.

    Rows are first summed into cells (one for each combination of categories). A step sums gradient and Hessian
    over the cells on the executors and solves for at most max_duals duals on the driver (more: ValueError).
    A singular Hessian (families share a free constant) is solved in the least-squares sense.
    """
    names = [(c, k) for c, ks in families.items() for k in ks]
    if len(names) > max_duals:
        raise ValueError(f"{len(names)} duals; max_duals is {max_duals}")
    at = {n: i for i, n in enumerate(names)}
    goal = np.array([families[c][k] for c, k in names], float)
    live = goal > 0
    cols = list(families)
    cells = staged(docs.groupBy(*cols).agg(F.sum(size).cast("double").alias("mass")).where("mass > 0"), "cells")
    lam = np.zeros(len(names))
    spark = docs.sparkSession
    for _ in range(steps):
        rated = cells
        total = F.lit(0.0)
        ok = F.lit(True)
        for j, c in enumerate(cols):
            rows = [(k, float(lam[at[c, k]]), bool(live[at[c, k]])) for k in families[c]]
            duals = spark.createDataFrame(rows, f"k{j} string, l{j} double, ok{j} boolean")
            rated = rated.join(F.broadcast(duals), F.col(c).eqNullSafe(F.col(f"k{j}")), "left").drop(f"k{j}")
            total, ok = total + F.coalesce(F.col(f"l{j}"), F.lit(0.0)), ok & F.coalesce(F.col(f"ok{j}"), F.lit(True))
        rated = rated.withColumn("m", F.when(ok, F.col("mass") * F.exp(total)).otherwise(0.0))
        grad, hess = -goal.copy(), np.zeros((len(names),) * 2)
        for a, c in enumerate(cols):
            for d in cols[a:]:
                for r in rated.groupBy(*dict.fromkeys([c, d])).agg(F.sum("m").alias("m")).collect():
                    if (c, r[c]) in at and (d, r[d]) in at:
                        i, j = at[c, r[c]], at[d, r[d]]
                        hess[i, j] = hess[j, i] = r["m"]
                        if c == d:
                            grad[i] += r["m"]
        grad[~live] = 0
        if np.abs(grad).max(initial=0) <= tol * max(1.0, goal.sum()):
            break
        move = np.linalg.lstsq(hess, grad, rcond=1e-12)[0]
        lam -= move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-300))
    return {c: {k: float(lam[at[c, k]]) if live[at[c, k]] else float("-inf") for k in families[c]} for c in cols}


def _extras(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one source, large sizes first: how many documents of each size take one copy more."""
    pdf = pdf.sort_values("size", ascending=False, kind="stable")
    carry, out = 0.0, []
    for size, n, frac in zip(pdf["size"], pdf["n"], pdf["frac"]):
        want = frac * size * n + carry
        m = min(int(n), max(0, int(np.floor(want / size + 0.5)))) if size > 0 else 0
        carry = want - m * size
        out.append(m)
    return pdf.assign(m=np.array(out, "int64"))[["source", "size", "m"]]


def rounded_copies(base: DataFrame, cells: DataFrame, rates: DataFrame, most: int = 3) -> DataFrame:
    """base (doc_id, source, size, th) with whole copies near each source's rate, at most `most` for a document.

    cells: (source, size, n) of base. Documents of one source and size are interchangeable. From the largest size down,
    each size rounds the extra copies it needs and carries the rest (under half a document) to the next, so a source misses
    its target by about half its smallest document. The number is then dealt over hash buckets (their number grows
    with the rows), so that ranking documents inside a bucket never gathers a hot size in one task. The order is a hash of
    doc_id and text: reruns agree.
    """
    small_batches(base.sparkSession)
    total = cells.agg(F.sum("n")).first()[0] or 0
    k = F.least(F.floor(F.col("rate") + F.lit(1e-9)), F.lit(most)).cast("long")
    rates = rates.withColumn("whole", k)
    rates = rates.withColumn("frac", F.when(F.col("whole") >= most, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("rate") - F.col("whole"))))
    rates = rates.select(F.col("source").alias("__s"), "whole", "frac")
    columns = base.columns
    base = base.withColumn("__h", F.xxhash64("doc_id", "th")).withColumn("__b", F.pmod("__h", F.lit(-(-max(1, total) // (3 * RANKED)))).cast("int"))
    per_size = cells.join(rates, F.col("source").eqNullSafe(F.col("__s"))).select("source", "size", "n", "whole", "frac")
    extra = per_size.groupBy("source").applyInPandas(_extras, "source string, size long, m long")
    extra = extra.select(F.col("source").alias("__s"), F.col("size").alias("__z"), "m")
    dealt = Window.partitionBy("source", "size").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = base.groupBy("source", "size", "__b").agg(F.count("*").alias("nb"))
    buckets = buckets.join(extra, F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z")))
    buckets = buckets.withColumn("mb", F.greatest(F.lit(0), F.least(F.col("nb"), F.col("m") - F.coalesce(F.sum("nb").over(dealt), F.lit(0)))))
    buckets = buckets.join(rates.withColumnRenamed("__s", "__s2"), F.col("source").eqNullSafe(F.col("__s2")))
    buckets = buckets.select(F.col("source").alias("__cs"), F.col("size").alias("__cz"), F.col("__b").alias("__cb"), "mb", "whole")
    rank = F.row_number().over(Window.partitionBy("source", "size", "__b").orderBy("__h", F.col("doc_id").asc_nulls_last(), "th"))
    ranked = base.withColumn("__r", rank)
    on = F.col("source").eqNullSafe(F.col("__cs")) & (F.col("size") == F.col("__cz")) & (F.col("__b") == F.col("__cb"))
    return ranked.join(buckets, on).select(*columns, (F.col("whole") + (F.col("__r") <= F.col("mb")).cast("long")).alias("copies"))


def mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, th, copies) and (source, source_size, target, dual, rate)."""
    base = staged(sizes(docs), "sizes")
    cells = staged(base.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    totals = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    rates = balance_one(cells.withColumn("mass", F.col("size") * F.col("n")), weighted_targets(totals, weights, most))
    return rounded_copies(base, cells, rates, most), rates


def mixed(docs: DataFrame, weights=(5.0, 2.0, 1.0), most: int = 3) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it. The texts are shuffled once, beside the copies.

    Rows equal in doc_id, source and text are one document here, with all their copies; its other columns are those of the
    row that comes first in the order of all columns."""
    copies, _ = mix(docs, weights, most)
    taken = copies.groupBy(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("th").alias("__t")).agg(F.sum("copies").alias("__k"), F.count("*").alias("__m")).where("__k > 0")
    on = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("__th") == F.col("__t"))
    rows = docs.withColumn("__th", F.xxhash64("text")).join(staged(taken, "taken"), on)
    row = F.struct(*docs.columns)
    one = rows.where("__m = 1").select(row.alias("__row"), "__k")
    several = rows.where("__m > 1").groupBy("__d", "__s", "__t", "__k").agg(F.min(row).alias("__row")).select("__row", "__k")
    return one.unionByName(several).withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__k")))).select("__row.*")


def query(docs: DataFrame) -> DataFrame:
    """The registered query: each document with its source's size and target and the words that the mix takes."""
    copies, rates = mix(docs)
    rates = rates.select(F.col("source").alias("__s"), "source_size", "target", "rate")
    out = copies.join(rates, F.col("source").eqNullSafe(F.col("__s")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies", "rate")
