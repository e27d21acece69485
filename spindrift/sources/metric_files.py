"""Metric and latency files: JSON lines of samples, CSV of latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC = "ts timestamp, node string, type string, value double"
LATENCY = "sched_ms double, latency_us long, status string, epoch long, recall double"


def finite(samples: DataFrame) -> DataFrame:
    """Samples whose value is a number: JSON has no NaN or infinity."""
    return samples.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def write_metrics(samples: DataFrame, path: str) -> None:
    finite(samples).select("ts", F.col("node").cast("string").alias("node"), "type", "value").write.mode("append").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """operator_id, ts, type, value."""
    return spark.read.schema(METRIC).json(path).select(F.col("node").alias("operator_id"), "ts", "type", "value")


def write_latency(rows: DataFrame, path: str) -> None:
    """CSV files in order of schedule: file by file and within each."""
    rows.select("sched_ms", "latency_us", "status", "epoch", "recall").orderBy("sched_ms").write.mode("overwrite").option("header", True).csv(path)


def read_latency(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LATENCY).option("header", True).csv(path)
