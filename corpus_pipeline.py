"""A training-data pipeline over `documents`: toxicity, line dedup, near duplicates, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and
hands what it reads back to the next. All but the last keep the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bpe, jaccard, linededup, mixing, toxicity
from spindrift.llm.common import WORD, discard, release, staged, staging, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity operator rejects. Null and empty texts have no evidence and stay; rows repeated
    in full go or stay together."""
    release(spark)
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of three lines in a row; n_chars follows the text.

    A document that loses lines and has no word left goes: all it had is in others. Null texts, and texts that had no
    repeated lines, stay as they are, with or without words."""
    out = linededup.dedup(docs).where((F.col("__removed") == 0) | F.col("text").rlike(WORD)).drop("__removed", "__kept")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity 0.8 or more on five-word shingles, keeps the one with the smallest doc_id.

    Documents without words are linked with nothing and stay. Rows equal in doc_id and text are one document, with the other
    columns of the row that is first in the order of all columns; those that share a doc_id alone, or have none, are linked
    by their texts like any others."""
    found = jaccard.join(docs, 5, 80, 100)
    alone = found.where("n_shingles = 0").groupBy("doc_id", "th").agg(F.count("*").alias("__k"))
    first = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("f"))
    names = found.where("n_shingles > 0").groupBy("doc_id", "th").agg(F.count("*").alias("__k"))
    winners = first.select("f.doc_id", "f.th").alias("w").join(names.alias("n"), F.col("w.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("w.th") == F.col("n.th"))).select("w.doc_id", "w.th", "__k")
    winners = staged(winners.unionByName(alone.withColumn("__k", F.lit(1).cast("long"))).select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "__k"), "winners")
    kept = docs.withColumn("__th", F.xxhash64("text")).join(winners, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__t")))
    one = kept.where("__k = 1").select(*docs.columns)
    several = kept.where("__k > 1").groupBy("__d", "__t").agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return one.unionByName(several)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources have their weights' shares of the words. Documents without words have
    size 0 and stay at their source's rate like others; a null source is a source."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that the mix takes, as counts and digests. Null texts are empty and have no ids."""
    release(spark)
    return bpe.encode_documents(docs)


STAGES = [("toxicity", reject_toxic), ("line_dedup", dedup_lines), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("bpe", encode)]

#: Not expressible in SQL: a fitted curve, set similarity components, rounding with a carry, BPE merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage staged on its way, and the table before it, go once its own table is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with staging(spark) as kept:
            out = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(out)
        discard(docs)
        docs = out
    return docs
