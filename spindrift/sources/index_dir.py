"""An index as a folder of Parquet tables with meta.json: saved by stage, resumed, checked against its input."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import distributed as D
from spindrift.operators import index as I
from spindrift.operators import train as T

TABLES = ("heads", "postings", "codebook", "codes", "layout", "list_part")


class IndexDir:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str = ""):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def done(self, name: str) -> bool:
        fs, p = self._fs(f"{name}/_SUCCESS")
        return fs.exists(p)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def meta(self) -> dict | None:
        fs, p = self._fs("meta.json")
        if not fs.exists(p):
            return None
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/meta.json").collect()))

    def _save_meta(self, meta: dict) -> None:
        fs, p = self._fs("meta.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(meta, sort_keys=True).encode()))
        out.close()

    def build(self, vectors: DataFrame, p: I.Params = I.Params(), parts: int = 8, vpp: int = 16, heads: DataFrame | None = None, codebook: DataFrame | None = None, trained: bool = False) -> None:
        """Runs the stages that are not there yet. Another input or other parameters than the folder's raise ValueError.

        trained: heads are the middles of balanced clusters of the whole table and the codebook is trained on it, instead of ids
        divisible by ten and the first vectors."""
        first = vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("vec_id", "v").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum")).first()
        meta = {"vectors": first["n"], "checksum": first["sum"], "m": p.m, "eps": p.eps, "replicas": p.replicas, "candidates": p.candidates, "parts": parts, "vpp": vpp, "trained": trained}
        old = self.meta()
        if old is not None and old != meta:
            raise ValueError(f"the folder holds an index of other data: {old}")
        self._save_meta(meta)
        stages = {
            "heads": lambda: heads if heads is not None else T.heads(vectors) if trained else I.heads_of(vectors),
            "postings": lambda: I.assign(vectors, self.read("heads"), p),
            "codebook": lambda: codebook if codebook is not None else T.train_codebook(vectors, p.m, iterations=10) if trained else I.codebook_of(vectors, p.m),
            "codes": lambda: I.encode(vectors, self.read("codebook"), p.m),
            "layout": lambda: I.bucket_layout(self.read("postings").where("rank = 1"), vpp).repartitionByRange("loc").sortWithinPartitions("loc"),
            "list_part": lambda: D.range_partitions(self.read("heads"), parts),
        }
        for name, make in stages.items():
            if not self.done(name):
                make().write.mode("overwrite").parquet(f"{self.path}/{name}")

    def segment(self) -> None:
        """Postings by partition, with a checksum per list; readers of some partitions prune the others."""
        if self.done("segments"):
            return
        p = self.read("postings").join(self.read("list_part"), "list_id").join(self.read("layout").select("vec_id", "loc"), "vec_id")
        crc = F.crc32(F.concat_ws(",", F.col("list_id").cast("string"), F.col("vec_id").cast("string"), F.col("loc").cast("string")))
        p.withColumn("crc", crc).repartition("part").sortWithinPartitions("list_id", "vec_id").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/segments")

    def segments(self, parts: list[int] | None = None, check: bool = True) -> DataFrame:
        s = self.read("segments")
        s = s.where(F.col("part").isin(parts)) if parts is not None else s
        if check:
            crc = F.crc32(F.concat_ws(",", F.col("list_id").cast("string"), F.col("vec_id").cast("string"), F.col("loc").cast("string")))
            s = s.where(F.when(crc == F.col("crc"), True).otherwise(F.raise_error(F.lit("segment checksum differs")).cast("boolean")))
        return s

    def validate(self) -> dict[str, int]:
        """Counts of violations, all of which must be 0."""
        post, lay, lp, heads = (self.read(t) for t in ("postings", "layout", "list_part", "heads"))
        parts = self.meta()["parts"]
        return {
            "slot collisions": lay.groupBy("loc").count().where("count > 1").count(),
            "lists without partition": heads.join(lp, "list_id", "left_anti").count(),
            "partitions out of range": lp.where((F.col("part") < 0) | (F.col("part") >= parts)).count(),
            "postings of unknown lists": post.join(heads, "list_id", "left_anti").count(),
            "postings without location": post.join(lay, "vec_id", "left_anti").count(),
            "repeated postings": post.groupBy("list_id", "vec_id").count().where("count > 1").count(),
        }

    def describe(self) -> DataFrame:
        """name, rows of each table."""
        out = None
        for t in TABLES:
            n = self.read(t).agg(F.lit(t).alias("name"), F.count("*").alias("rows"))
            out = n if out is None else out.unionByName(n)
        return out

    def sizes(self) -> DataFrame:
        """name, files, bytes on storage of each table and of the segments; one listing a folder, nothing is read."""
        rows = []
        for t in [*TABLES, "segments"]:
            fs, p = self._fs(t)
            if fs.exists(p):
                c = fs.getContentSummary(p)
                rows.append((t, c.getFileCount(), c.getLength()))
        return self.spark.createDataFrame(rows, "name string, files long, bytes long")


class AnnIndex:
    """Search over a built folder."""

    def __init__(self, folder: IndexDir, vectors: DataFrame, max_nprobe: int = 1 << 16, max_rerank: int = 1 << 20):
        self.dir, self.vectors, self.bounds = folder, vectors, (max_nprobe, max_rerank)

    def search(self, queries: DataFrame, p: I.Params = I.Params(), heuristic: bool = False) -> DataFrame:
        """qid, rank, vec_id, dist; or with heuristic a row per query with its counters."""
        p.bounded(*self.bounds)
        d = self.dir
        probed = I.navigate(queries, d.read("heads"), p.nprobe)
        luts = I.distance_tables(queries, d.read("codebook"), p.m)
        f = I.filter_stage(I.gather(probed, d.read("postings")), d.read("codes"), luts, p.n, m=p.m)
        if heuristic:
            return I.heuristic_rerank(f, self.vectors, queries, d.read("layout"), p.k)
        return I.rerank(f, self.vectors, queries, p.k)

    def describe(self) -> DataFrame:
        return self.dir.describe()
