"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Only in local mode may that be unset: there one machine reads and writes it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spindrift-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage and survives lost executors. The caller discards it."""
    path = shared(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(t._staged)
        p.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
