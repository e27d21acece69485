"""Page files as a data source, format("pagefile"): reads of chosen pages only.

A page has vpp slots of one vector each and is padded to page_bytes; location = page * vpp + slot. Filters on page or loc (=, in, <, <=, >,
>=) are pushed down and become byte ranges: runs of consecutive pages are one read, and the pages asked for are dealt over partitions; no
other byte is read. Files come in parts of whole pages, listed at the path in a JSON manifest. Slots that hold no vector are zeros: which ones those are
is the layout's to say, so rows are joined with it. Needs spark.sql.python.filterPushdown.enabled, which read_pages sets.
"""

from __future__ import annotations

import bisect
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from spindrift.shipping import ship
from spindrift.sources.vecfiles import DTYPES, _open

#: Pages of a partition, and of a part as written.
PAGES, PART_PAGES = 4096, 16_384


class _Pages(InputPartition):
    def __init__(self, runs: list[tuple[str, int, int, int]]):
        """runs: part, its first page, and the pages lo to hi (without hi) to read from it."""
        super().__init__(runs)


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        f, p = _open(self.path)
        with f.open_input_stream(p) as s:
            m = json.loads(s.read())
        self.parts, self.dim, self.vpp, self.page_bytes, self.dtype = (m[k] for k in ("parts", "dim", "vpp", "page_bytes", "dtype"))
        self.lo, self.hi, self.only = 0, 1 << 62, None

    def pushFilters(self, filters):
        """Bounds and sets of pages; a filter on loc narrows the pages and is checked again by Spark, row by row."""
        for x in filters:
            name = getattr(x, "attribute", (None,))
            if name not in (("page",), ("loc",)) or not isinstance(x, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield x
                continue
            unit = self.vpp if name == ("loc",) else 1
            values = [v for v in (x.value if isinstance(x, In) else [x.value]) if v is not None]
            if isinstance(x, (EqualTo, In)):
                pages = {int(v) // unit for v in values}
                self.only = pages if self.only is None else self.only & pages
            elif isinstance(x, (GreaterThan, GreaterThanOrEqual)):
                self.lo = max(self.lo, (int(x.value) + isinstance(x, GreaterThan)) // unit)
            else:
                last = int(x.value) - isinstance(x, LessThan)
                self.hi = min(self.hi, last // unit + 1)
            if unit > 1:
                yield x

    def runs(self) -> list[tuple[str, int, int, int]]:
        """What is to be read, in order of pages."""
        out = []
        only = sorted(self.only) if self.only is not None else None
        for name, first, n in self.parts:
            lo, hi = max(first, self.lo), min(first + n, self.hi)
            if only is None:
                out += [(name, first, a, min(a + PAGES, hi)) for a in range(lo, hi, PAGES)]
                continue
            for page in only[bisect.bisect_left(only, lo) : bisect.bisect_left(only, hi)]:
                if out and out[-1][0] == name and out[-1][3] == page:
                    out[-1] = (*out[-1][:3], page + 1)
                else:
                    out.append((name, first, page, page + 1))
        return out

    def partitions(self):
        out, some, size = [], [], 0
        for r in self.runs():
            if some and size + r[3] - r[2] > PAGES:
                out.append(_Pages(some))
                some, size = [], 0
            some.append(r)
            size += r[3] - r[2]
        return [*out, _Pages(some)]

    def read(self, partition):
        item = np.dtype(DTYPES[self.dtype])
        for name, first, lo, hi in partition.value:
            f, p = _open(self.path.rsplit("/", 1)[0] + "/" + name)
            with f.open_input_file(p) as s:
                raw = s.read_at((hi - lo) * self.page_bytes, (lo - first) * self.page_bytes)
            x = np.frombuffer(raw, "uint8").reshape(hi - lo, self.page_bytes)[:, : self.vpp * self.dim * item.itemsize]
            v = np.ascontiguousarray(x).view(item).astype("float32").ravel()
            n = (hi - lo) * self.vpp
            loc = np.arange(lo * self.vpp, hi * self.vpp)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * self.dim + 1, self.dim), "int32"), pa.array(v))
            yield pa.RecordBatch.from_arrays([pa.array(loc // self.vpp), pa.array((loc % self.vpp).astype("int32")), pa.array(loc), flat], ["page", "slot", "loc", "embedding"])


class _Part(WriterCommitMessage):
    def __init__(self, name, first, pages, dim):
        self.name, self.first, self.pages, self.dim = name, first, pages, dim


class PageWriter(DataSourceWriter):
    """Rows (loc, embedding) in order of loc, whole pages task by task."""

    def __init__(self, options):
        self.path, self.tag = options["path"], uuid.uuid4().hex
        self.vpp, self.page_bytes, self.dtype = int(options["vpp"]), int(options["page_bytes"]), options.get("dtype") or "float32"

    def write(self, rows):
        f, p = _open(self.path)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.pages"
        folder = f"{p}.{self.tag}"
        f.create_dir(folder, recursive=True)
        first, done, last, page, dim = None, 0, -1, bytearray(self.page_bytes), 0
        with f.open_output_stream(f"{folder}/{name}") as out:
            for r in rows:
                v = np.asarray(r["embedding"], DTYPES[self.dtype])
                if len(v) * v.itemsize * self.vpp > self.page_bytes or dim and len(v) != dim:
                    raise ValueError(f"location {r['loc']}: {len(v)} dimensions, others {dim}, {self.vpp} slots in {self.page_bytes} bytes")
                if r["loc"] == last:
                    raise ValueError(f"location {last} is taken twice")
                dim, last = len(v), r["loc"]
                first = last // self.vpp if first is None else first
                while first + done < last // self.vpp:
                    out.write(bytes(page))
                    page, done = bytearray(self.page_bytes), done + 1
                at = last % self.vpp * len(v) * v.itemsize
                page[at : at + len(v) * v.itemsize] = v.tobytes()
            if first is not None:
                out.write(bytes(page))
                done += 1
        return _Part(f"{folder.rsplit('/', 1)[-1]}/{name}", first, done, dim)

    def commit(self, messages):
        f, p = _open(self.path)
        parts = sorted((m for m in messages if m and m.pages), key=lambda m: m.first)
        m = {"parts": [(x.name, x.first, x.pages) for x in parts], "dim": parts[0].dim if parts else 0, "vpp": self.vpp, "page_bytes": self.page_bytes, "dtype": self.dtype}
        with f.open_output_stream(p) as out:
            out.write(json.dumps(m).encode())

    def abort(self, messages):
        pass


class PageFile(DataSource):
    @classmethod
    def name(cls):
        return "pagefile"

    def schema(self):
        return "page long, slot int, loc long, embedding array<float>"

    def reader(self, schema):
        return PageReader(self.options)

    def writer(self, schema, overwrite):
        return PageWriter(self.options)


def read_pages(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """page, slot, loc, embedding of all slots, or of those that `where` keeps; filters on page and loc decide what is read.

    Spark keeps one reader for all uses of a relation in a plan, with the filters of the last: a plan that joins or unites different
    choices of pages calls this once for each."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    ship(spark).dataSource.register(PageFile)
    p = spark.read.format("pagefile").option("path", path).load()
    return p.where(where) if where else p


def save_pages(vectors: DataFrame, layout: DataFrame, path: str, vpp: int, page_bytes: int = 4096, dtype: str = "float32") -> None:
    """vectors (vec_id, embedding) at the locations of layout (vec_id, page, loc). Two vectors at one location are an error."""
    ship(vectors.sparkSession).dataSource.register(PageFile)
    rows = layout.join(vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")), "vec_id")
    parts = max(1, -(-layout.agg(F.countDistinct("page")).first()[0] // PART_PAGES))
    rows = rows.repartitionByRange(parts, "page").sortWithinPartitions("loc").select(F.col("page").cast("long").alias("page"), F.lit(0).alias("slot"), F.col("loc").cast("long").alias("loc"), "embedding")
    rows.write.format("pagefile").mode("append").option("path", path).option("vpp", vpp).option("page_bytes", page_bytes).option("dtype", dtype).save()
