"""What the operators of this subpackage share: tables, the shared folder, salted lookups, Arrow batches."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.shipping import ship

#: Words are runs of anything but these ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: An Arrow batch holds at most so many rows and about so many bytes (a longer text is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 1000, "8m"
#: Folders of the staged tables that are still there, in the order written.
_folders: list[str] = []
#: Folders of applications in local mode that name none.
_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a folder of this machine's is made (one an application), but
    only in local mode, whose one process reads and writes it; a cluster without a shared folder is an error. The setting itself is
    left as it is: a running session can't change it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        path = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="spindrift-"))
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage and survives lost executors.

    The shuffle files that made it are not needed any more; Spark removes them once the driver's JVM has collected their
    handles, which is asked for here (see release()). The table stays until discard() or the end of its staging()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _folders.append(path)
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def release(spark: SparkSession) -> None:
    """The driver's JVM collects its garbage and gives back the native memory that it has freed.

    Without being asked, the C library keeps what the JVM's compilers, threads and buffers have freed (some 190 MB after
    three small runs of the pipeline). A JVM that has no such command keeps it."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    with contextlib.suppress(Py4JError):
        kinds = gateway.new_array(jvm.java.lang.Class, 4)
        for i, c in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.java.lang.Class.forName(c)
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # the server's class is not exported, but its interface is
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, args)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    with contextlib.suppress(ValueError):
        _folders.remove(path)


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more: what was made of them has been staged itself."""
    for t in tables:
        if path := getattr(t, "_staged", None):
            _delete(t.sparkSession, path)


@contextlib.contextmanager
def staging(spark: SparkSession):
    """At the end, deletes what was staged inside but for the tables that were added to the list it yields."""
    kept: list[DataFrame] = []
    before = set(_folders)
    yield kept
    stay = before | {getattr(t, "_staged", None) for t in kept}
    for path in [p for p in _folders if p not in stay]:
        _delete(spark, path)


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes (the same for all operators, so their order does not matter); gives the
    executors this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, not copied, and each one's offset with the end after the last."""
    if not len(col):
        return np.empty(0, "uint8"), np.zeros(1, "int64")
    wide = pa.types.is_large_string(col.type)
    _, places, data = col.buffers()
    offsets = np.frombuffer(places, "<i8" if wide else "<i4")[col.offset : col.offset + len(col) + 1].astype("int64")
    return np.frombuffer(data, "uint8") if data is not None else np.empty(0, "uint8"), offsets


def salted_left_join(big: DataFrame, small: DataFrame, key: str, salt_on: list[str], salts: int = 8) -> DataFrame:
    """Left join on key, which is unique in small; a hot key of big is dealt over `salts` partitions, and as big is the
    outer side, adaptive execution splits what is still too large for a task.

    small must hold only keys that repeat (so that copying it `salts` times is cheap). Null keys match nothing.
    """
    left = big.withColumn("__salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [key, "__salt"], "left").drop("__salt")
