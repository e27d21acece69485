"""A table of Parquet files as a stream with offsets, format("eventlog"): batches bounded by rows, not by files.

An offset is a number of rows, over the files in order of their names; a batch takes the next batch_rows rows and is dealt over partitions by
row group. Spark keeps the offsets; as a source is not told where a restarted query stands, the reader also writes what Spark has committed
to the file that option position names, on the driver. If that is behind (the process ended between both), the next batch may hold twice
the rows; none is left out or comes twice, as Spark's own start and end are what is read. Files that are added later must sort after the others.
"""

from __future__ import annotations

import json

import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from spindrift.shipping import ship
from spindrift.sources.vecfiles import _open


class _Rows(InputPartition):
    """Rows lo to hi of a row group of a file."""

    def __init__(self, path: str, group: int, lo: int, hi: int):
        super().__init__((path, group, lo, hi))


class EventLogReader(DataSourceStreamReader):
    def __init__(self, options, schema):
        self.path, self.position, self.most = options["path"], options["position"], int(options.get("batch_rows") or 10_000)
        self.names = schema.fieldNames()
        self.at, self.told = self._kept(), None
        self.groups: list[tuple[str, int, int]] = []
        self.known: set[str] = set()

    def _kept(self) -> int:
        f, p = _open(self.position)
        if f.get_file_info(p).type == pafs.FileType.NotFound:
            return 0
        with f.open_input_stream(p) as s:
            return json.loads(s.read())["row"]

    def _look(self) -> int:
        """Lists the row groups of new files; the number of rows there are."""
        f, p = _open(self.path)
        info = f.get_file_info(p)
        files = [p] if info.type == pafs.FileType.File else sorted(x.path for x in f.get_file_info(pafs.FileSelector(p)) if x.path.endswith(".parquet"))
        for name in files:
            if name not in self.known:
                with f.open_input_file(name) as s:
                    meta = pq.ParquetFile(s).metadata
                    self.groups += [(name, g, meta.row_group(g).num_rows) for g in range(meta.num_row_groups)]
                self.known.add(name)
        return sum(n for _, _, n in self.groups)

    def initialOffset(self):
        return {"row": 0}

    def latestOffset(self):
        if self.told is not None and self.told > self.at:
            self.at = self.told  # what was told before has become no batch, so it is Spark's start already
        self.told = max(self.at, min(self._look(), self.at + self.most))
        return {"row": self.told}

    def partitions(self, start, end):
        self._look()
        self.at, self.told = max(self.at, start["row"]), None
        out, first = [], 0
        for name, g, n in self.groups:
            lo, hi = max(start["row"], first), min(end["row"], first + n)
            if lo < hi:
                out.append(_Rows(name, g, lo - first, hi - first))
            first += n
        self.at = end["row"]
        return out

    def read(self, partition):
        name, g, lo, hi = partition.value
        f, _ = _open(self.path)
        with f.open_input_file(name) as s:
            t = pq.ParquetFile(s).read_row_group(g, columns=self.names).select(self.names).slice(lo, hi - lo)
        yield from t.to_batches()

    def commit(self, end):
        f, p = _open(self.position)
        f.create_dir(p.rsplit("/", 1)[0], recursive=True)
        with f.open_output_stream(p + ".new") as s:
            s.write(json.dumps(end).encode())
        f.move(p + ".new", p)


class EventLog(DataSource):
    @classmethod
    def name(cls):
        return "eventlog"

    def schema(self):
        return "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"

    def streamReader(self, schema):
        return EventLogReader(self.options, schema)


def stream(spark: SparkSession, path: str, position: str, batch_rows: int = 10_000, schema: str | None = None) -> DataFrame:
    """The rows of the files at path as a stream, at most batch_rows a batch. position: a file for this query alone."""
    ship(spark).dataSource.register(EventLog)
    r = spark.readStream.format("eventlog")
    return (r.schema(schema) if schema else r).option("path", path).option("position", position).option("batch_rows", batch_rows).load()
