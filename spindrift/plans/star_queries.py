"""Registered queries of the general relational operators, over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.plans.declare import query


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


@query("G1_pricing", f"SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum({_CENTS}) AS BIGINT) AS cents, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY ALL")
def pricing(spark, sf):
    l = _t(spark, sf, "lineitem")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))


@query("G2_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def semi(spark, sf):
    o = _t(spark, sf, "orders").where("o_totalprice > 100000")
    c = _t(spark, sf, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("G3_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti(spark, sf):
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders").where("o_totalprice > 300000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("G4_rollup", "SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)")
def rollup(spark, sf):
    c, n = _t(spark, sf, "customer"), _t(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).rollup("n_name", "c_mktsegment").agg(F.count("*").alias("n"))


@query("G5_full_outer", "SELECT n_nationkey, s.n AS suppliers, c.n AS customers FROM nation LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON s.k = n_nationkey LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c ON c.k = n_nationkey WHERE s.n IS NOT NULL OR c.n IS NOT NULL")
def full_outer(spark, sf):
    s = _t(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    c = _t(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    return s.join(c, "n_nationkey", "full_outer")


@query("G6_topn_per_group", "SELECT o_custkey, o_orderkey, CAST(r AS INTEGER) AS r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def topn(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _t(spark, sf, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey", "r")


@query("G7_window_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders")
def frame(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return _t(spark, sf, "orders").select("o_orderkey", F.count("*").over(w.rowsBetween(-2, 0)).alias("recent"), F.lag("o_orderkey").over(w).alias("prev"))


@query("G8_grouping_sets", "SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_linestatus), (l_returnflag), ())")
def grouping_sets(spark, sf):
    _t(spark, sf, "lineitem").createOrReplaceTempView("__lineitem")
    return spark.sql("SELECT l_linestatus, l_returnflag, count(*) AS n FROM __lineitem GROUP BY GROUPING SETS ((l_linestatus), (l_returnflag), ())")


@query("G9_five_way_join", f"SELECT r_name, n_name, count(*) AS n, CAST(sum({_CENTS}) AS BIGINT) AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def five_way(spark, sf):
    l, o, c, n, r = (_t(spark, sf, x) for x in ("lineitem", "orders", "customer", "nation", "region"))
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))


@query("G10_distinct_counts", "SELECT l_linestatus, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_linestatus")
def distinct_counts(spark, sf):
    return _t(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"))
