"""Vector and ground-truth files as data sources: format("vecfile") and format("gtfile").

A .u8bin, .i8bin or .fbin file has its number of rows and dimensions (unsigned 32-bit) and then the rows; .bvecs and .fvecs have the
dimensions before each row. The element type follows the extension unless option dtype names it; option max_n reads a
prefix. A header that promises more rows than the file has is cut with a warning. Rows are read by byte range, a partition each,
through pyarrow's file systems, so the file may lie in any store that those reach. Ground truth (.ibin with optional
distances, .ivecs) comes in long form: qid, rank, vec_id, dist.

Written files come in parts: every task writes its rows as a whole file of the format, and the commit leaves at the path a list of
the parts in order, which the readers take for one file. So no row passes the driver, and any part can be read by other tools.
"""

from __future__ import annotations

import json
import uuid
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from spindrift.shipping import ship

DTYPES = {"uint8": np.uint8, "int8": np.int8, "float32": np.dtype("<f4")}
#: Fixed values of the formats.
EXTENSIONS = {"u8bin": "uint8", "i8bin": "int8", "fbin": "float32", "bvecs": "uint8", "fvecs": "float32"}
ROWS = 65_536


def dtype_of(path: str) -> str:
    ext = path.rsplit(".", 1)[-1]
    if ext not in EXTENSIONS:
        raise ValueError(f"no element type for .{ext}")
    return EXTENSIONS[ext]


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        f, p = pafs.FileSystem.from_uri(path)
    else:
        f, p = pafs.LocalFileSystem(), path
    return f, p


@dataclass
class _Shape:
    n: int
    dim: int
    head: int
    stride: int
    lead: int  # bytes before each row's elements


def _shape(path: str, item: int, texmex: bool, max_n: int, extra: int = 0) -> _Shape:
    f, p = _open(path)
    size = f.get_file_info(p).size
    with f.open_input_file(p) as s:
        if texmex:
            dim = int(np.frombuffer(s.read_at(4, 0), "<i4")[0])
            stride = 4 + dim * item
            n, head, lead = size // stride, 0, 4
        else:
            n, dim = (int(x) for x in np.frombuffer(s.read_at(8, 0), "<u4"))
            stride, head, lead = dim * item, 8, 0
            there = (size - 8) // stride if stride else 0
            if there < n:
                warnings.warn(f"{path} promises {n} rows and has {there}", stacklevel=2)
                n = there
    return _Shape(min(n, max_n) if max_n else n, dim, head, stride, lead)


class _Range(InputPartition):
    """Rows lo to hi of a file whose first row is numbered `first`."""

    def __init__(self, path: str, lo: int, hi: int, first: int):
        super().__init__((path, lo, hi, first))


#: How a list of parts begins.
PARTS = b'{"parts":'


def parts_of(path: str) -> list[str]:
    """The files that path stands for, in order: itself, or the parts that it lists."""
    f, p = _open(path)
    with f.open_input_file(p) as s:
        if s.read(len(PARTS)) != PARTS:
            return [path]
        names = json.loads(PARTS + s.read())["parts"]
    return [path.rsplit("/", 1)[0] + "/" + n for n in names]


def _ranges(path: str, shape, max_n: int = 0) -> list[_Range]:
    out, first = [], 0
    for part in parts_of(path):
        n = shape(part).n
        n = min(n, max_n - first) if max_n else n
        out += [_Range(part, a, min(n, a + ROWS), first) for a in range(0, n, ROWS)]
        first += n
        if max_n and first >= max_n:
            break
    return out or [_Range(path, 0, 0, 0)]


class PartsWriter(DataSourceWriter):
    """Writes each task's rows as a file of its own and then, at the path, the list of them by task. Rows must come in order, task by task."""

    def __init__(self, options):
        self.path, self.tag = options["path"], uuid.uuid4().hex

    def part(self, out, rows) -> int:
        """Writes rows to the stream as one file; their number."""
        raise NotImplementedError

    def write(self, rows):
        f, p = _open(self.path)
        folder, ext = f"{p}.{self.tag}", self.path.rsplit(".", 1)[-1]
        task = TaskContext.get().partitionId()
        name = f"{task:06d}-{uuid.uuid4().hex}.{ext}"
        f.create_dir(folder, recursive=True)
        with f.open_output_stream(f"{folder}/{name}") as out:
            n = self.part(out, rows)
        return _Written(task, f"{folder.rsplit('/', 1)[-1]}/{name}", n)

    def commit(self, messages):
        f, p = _open(self.path)
        names = [m.name for m in sorted((m for m in messages if m and m.rows), key=lambda m: m.task)]
        with f.open_output_stream(f"{p}.{self.tag}.list") as out:
            out.write(PARTS + json.dumps(names).encode() + b"}")
        f.move(f"{p}.{self.tag}.list", p)

    def abort(self, messages):
        f, p = _open(self.path)
        if f.get_file_info(f"{p}.{self.tag}").type != pafs.FileType.NotFound:
            f.delete_dir(f"{p}.{self.tag}")


class _Written(WriterCommitMessage):
    def __init__(self, task, name, rows):
        self.task, self.name, self.rows = task, name, rows


class VectorReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.dtype = options.get("dtype") or dtype_of(self.path)
        self.max_n = int(options.get("max_n") or 0)
        self.texmex = self.path.endswith("vecs")

    def _shape(self, path):
        return _shape(path, np.dtype(DTYPES[self.dtype]).itemsize, self.texmex, 0)

    def partitions(self):
        return _ranges(self.path, self._shape, self.max_n)

    def read(self, partition):
        path, lo, hi, first = partition.value
        if hi == lo:
            return
        s = self._shape(path)
        f, p = _open(path)
        with f.open_input_file(p) as src:
            raw = src.read_at((hi - lo) * s.stride, s.head + lo * s.stride)
        rows = np.frombuffer(raw, np.uint8).reshape(hi - lo, s.stride)[:, s.lead :]
        v = np.ascontiguousarray(rows).view(DTYPES[self.dtype]).astype("float32").ravel()
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) + 1, max(1, s.dim)) if s.dim else np.zeros(hi - lo + 1), "int32"), pa.array(v))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + lo, first + hi)), flat], ["vec_id", "embedding"])


class VectorWriter(PartsWriter):
    def __init__(self, options):
        super().__init__(options)
        self.dtype = options.get("dtype") or dtype_of(self.path)

    def part(self, out, rows):
        texmex, n, dim, held = self.path.endswith("vecs"), 0, 0, []
        for r in rows:
            v = np.asarray(r["embedding"], DTYPES[self.dtype])
            if n and len(v) != dim:
                raise ValueError(f"vector {r['vec_id']} has {len(v)} dimensions, others {dim}")
            dim, n = len(v), n + 1
            held.append((np.int32(dim).tobytes() if texmex else b"") + v.tobytes())
        # the header has the number of rows, so a task's rows are held: save_bin bounds them
        out.write((b"" if texmex else np.array([n, dim], "<u4").tobytes()) + b"".join(held))
        return n


class VectorFile(DataSource):
    @classmethod
    def name(cls):
        return "vecfile"

    def schema(self):
        return "vec_id long, embedding array<float>"

    def reader(self, schema):
        return VectorReader(self.options)

    def writer(self, schema, overwrite):
        return VectorWriter(self.options)


class TruthReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.texmex = self.path.endswith("ivecs")

    def partitions(self):
        return _ranges(self.path, lambda path: _shape(path, 4, self.texmex, 0))

    def read(self, partition):
        path, lo, hi, first = partition.value
        if hi == lo:
            return
        s = _shape(path, 4, self.texmex, 0)
        f, p = _open(path)
        size = f.get_file_info(p).size
        with f.open_input_file(p) as src:
            raw = src.read_at((hi - lo) * s.stride, s.head + lo * s.stride)
            ids = np.frombuffer(raw, np.uint8).reshape(hi - lo, s.stride)[:, s.lead :]
            ids = np.ascontiguousarray(ids).view("<u4").astype("int64")
            dist = None
            if not self.texmex and size >= s.head + 2 * s.n * s.stride:
                dist = np.frombuffer(src.read_at((hi - lo) * s.stride, s.head + s.n * s.stride + lo * s.stride), "<f4").astype("float64")
        q = np.repeat(np.arange(first + lo, first + hi), s.dim)
        rank = np.tile(np.arange(1, s.dim + 1, dtype="int32"), hi - lo)
        d = pa.nulls(len(q), pa.float64()) if dist is None else pa.array(dist)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(rank), pa.array(ids.ravel()), d], ["qid", "rank", "vec_id", "dist"])


class TruthWriter(PartsWriter):
    """A row of k ids per query, then all distances (none for .ivecs)."""

    def part(self, out, rows):
        texmex, ids, dist = self.path.endswith("ivecs"), [], []
        for r in rows:
            ids.append(np.array(r["ids"], "<u4"))
            dist.append(np.array([0.0 if d is None else d for d in r["dists"]], "<f4"))
            if len(ids[-1]) != len(ids[0]):
                raise ValueError(f"query {r['qid']} has {len(ids[-1])} neighbours, others {len(ids[0])}")
        k = len(ids[0]) if ids else 0
        if texmex:
            out.write(b"".join(np.int32(k).tobytes() + x.tobytes() for x in ids))
        else:
            out.write(np.array([len(ids), k], "<u4").tobytes() + b"".join(x.tobytes() for x in ids) + b"".join(x.tobytes() for x in dist))
        return len(ids)


class TruthFile(DataSource):
    @classmethod
    def name(cls):
        return "gtfile"

    def schema(self):
        return "qid long, rank int, vec_id long, dist double"

    def reader(self, schema):
        return TruthReader(self.options)

    def writer(self, schema, overwrite):
        return TruthWriter(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(VectorFile)
    spark.dataSource.register(TruthFile)


def read_vectors(spark: SparkSession, path: str, dtype: str | None = None, max_n: int = 0) -> DataFrame:
    register(spark)
    r = spark.read.format("vecfile").option("path", path).option("max_n", max_n)
    return (r.option("dtype", dtype) if dtype else r).load()


def _in_order(df: DataFrame, key: str, part_rows: int) -> DataFrame:
    """df by ranges of key, of about part_rows rows a task."""
    return df.repartitionByRange(max(1, -(-df.count() // part_rows)), key).sortWithinPartitions(key)


def save_bin(vectors: DataFrame, path: str, dtype: str | None = None, part_rows: int = ROWS) -> None:
    """One file in order of vec_id, in parts of about part_rows rows."""
    register(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    w = _in_order(rows, "vec_id", part_rows).write.format("vecfile").mode("append").option("path", path)
    (w.option("dtype", dtype) if dtype else w).save()


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("gtfile").option("path", path).load()


def save_truth(truth: DataFrame, path: str, part_rows: int = ROWS) -> None:
    """.ibin with distances, or .ivecs, in order of qid: one row of k ids per query, in parts of about part_rows queries."""
    register(truth.sparkSession)
    x = truth.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "dist"))).alias("x"))
    rows = x.select(F.col("qid").cast("long").alias("qid"), F.col("x.vec_id").cast("array<long>").alias("ids"), F.col("x.dist").cast("array<double>").alias("dists"))
    _in_order(rows, "qid", part_rows).write.format("gtfile").mode("append").option("path", path).save()
