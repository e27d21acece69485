"""Structured Streaming versions of the reports: per-interval summaries with a watermark, pinned queries, absent batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.folders import shared

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def sample_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events in a file or folder as a stream of samples: ts, node, type, us, status."""
    reader = spark.readStream.schema(EVENTS).format("parquet")
    folder, _, name = path.rstrip("/").rpartition("/")
    s = reader.option("pathGlobFilter", name).load(folder) if _is_file(spark, path) else reader.load(path)
    return s.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("node"), F.col("event_type").alias("type"), F.floor(F.col("value") * 1000).cast("long").alias("us"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))


def interval_reports(samples: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """w, type, n, busy_us, failed per interval. State is one row per open interval and type."""
    g = samples.withWatermark("ts", late).groupBy(F.window("ts", width).alias("win"), "type")
    r = g.agg(F.count("*").alias("n"), F.sum("us").alias("busy_us"), F.count_if(F.col("status") == "failed").alias("failed"))
    return r.select(F.unix_timestamp("win.start").alias("w"), "type", "n", "busy_us", "failed")


def drained(spark: SparkSession, path: str) -> DataFrame:
    """All intervals of the events at `path`, as the stream's final table.

    Every update of an interval is appended to a table; the last one of each interval is the report. This also closes
    intervals that the watermark has not passed when the input ends."""
    where = shared(spark, "stream")

    def append(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{where}/out")

    q = interval_reports(sample_stream(spark, path)).writeStream.outputMode("update").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).foreachBatch(append).start()
    q.awaitTermination()
    out = spark.read.schema("w long, type string, n long, busy_us long, failed long, batch int").parquet(f"{where}/out")
    last = out.groupBy("w", "type").agg(F.max(F.struct("batch", "n", "busy_us", "failed")).alias("x"))
    return last.select("w", "type", "x.n", "x.busy_us", "x.failed")


def pinned(changes: DataFrame) -> DataFrame:
    """changes: node, epoch, d (+1 when a query is pinned, -1 when it ends). Running number of pinned queries per node and
    epoch; an epoch is drained when it and all before are 0. Built-in keyed aggregation keeps the state."""
    return changes.groupBy("node", "epoch").agg(F.sum("d").alias("pinned"))


def absent_batch(df: DataFrame, present_path: str, file_rows: int = 512) -> None:
    """Adds the rows (loc, data) of a batch that are still absent from the table at present_path, each location once."""
    spark = df.sparkSession
    new = df.dropDuplicates(["loc"])
    if _exists(spark, present_path):
        new = new.join(spark.read.parquet(present_path).select("loc"), "loc", "left_anti")
    new.write.mode("append").option("maxRecordsPerFile", file_rows).parquet(present_path)


def stream_absent(stream: DataFrame, present_path: str, checkpoint: str, batch_rows: int = 512):
    """Streams (loc, data) to the table at present_path, each batch only what is still absent there, once. A file that is written holds
    batch_rows rows at most; batches are bounded by the source (event_log.stream takes a number of rows)."""
    write = lambda df, _: absent_batch(df, present_path, batch_rows)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def _is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.getFileStatus(p).isFile()
