"""Line dedup over overlapping windows of three lines, in DataFrame functions only.

A text's lines are what "\\n" separates. Every three consecutive lines form a window, hashed to 128 bits. Of the
windows that are equal anywhere, the one with the smallest (doc_id, hash of the text, line) is kept; every other
occurrence is covered, and a document loses the lines that its covered windows reach, merged. A later occurrence
that overlaps the kept one itself (the same run of equal lines) is not covered, so that one whole window stays.
Windows are judged on the input, not on what is left.

Shuffled is one row per window (two hashes, document, line); a hot window is first summed per task, and the lookup of
repeated windows is salted, so no task gathers all occurrences.

Defined cases: a null text has no lines and stays null; texts of fewer than three lines keep all; blank lines are lines
like any other; rows equal in doc_id and text count as one document; null doc_ids are told apart by
their text and rank first; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_left_join, staged


def _windows(text: Column, width: int) -> Column:
    """Array of (line, h1, h2) for the windows."""
    lines = F.split(text, "\n", -1)
    both = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b")))
    start = F.when(F.size(lines) >= width, F.sequence(F.lit(0), F.size(lines) - width)).otherwise(F.array().cast("array<int>"))

    def window(own: Column) -> Column:
        def at(i: Column) -> Column:
            part = [F.get(own, i + j) for j in range(width)]
            return F.struct(i.alias("line"), F.xxhash64(*[p["a"] for p in part]).alias("h1"), F.xxhash64(*[p["b"] for p in part]).alias("h2"))

        return F.transform(start, at)

    # the hashes are bound once by a one-element array, so that no window hashes its lines again
    return F.flatten(F.transform(F.array(both), window))


def covered_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, th (hash of the text), covered: first lines of a document's covered windows."""
    base = docs.where(F.col("text").contains("\n")).select("doc_id", F.xxhash64("text").alias("th"), F.explode(_windows(F.col("text"), width)).alias("w"))
    base = staged(base.select("doc_id", "th", "w.line", "w.h1", "w.h2"), "windows")
    here = F.struct("doc_id", "th", "line")
    first = base.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.struct("h1", "h2").alias("h"), "first")
    seen = salted_left_join(base.select("doc_id", "th", "line", F.struct("h1", "h2").alias("h")), first, "h", ["doc_id", "th", "line"]).where("first is not null")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    later = seen.where(~same | (F.col("line") >= F.col("first.line") + width))
    return later.groupBy("doc_id", "th").agg(F.collect_set("line").alias("covered"))


def dedup(docs: DataFrame, width: int = 3) -> DataFrame:
    """All columns of docs, with the text that is left; __removed and __kept are the numbers of lines that went and stayed."""
    hit = covered_lines(docs, width).select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), F.col("covered").alias("__c"))
    keyed = docs.withColumn("__th", F.xxhash64("text"))
    out = keyed.join(hit, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__t")), "left")
    lines = F.split("text", "\n", -1)
    # merging covered positions: a line goes if a covered window starts at it or up to width - 1 lines before it
    gone = F.flatten(F.transform("__c", lambda c: F.sequence(c, c + (width - 1))))
    rest = lambda own: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), gone), lambda i: F.get(own, i)), "\n")
    # the lines are bound once, and array_except looks positions up by hash: linear in a document's lines
    text = F.when(F.col("__c").isNull(), F.col("text")).otherwise(F.get(F.transform(F.array(lines), rest), F.lit(0)))
    removed = F.when(F.col("__c").isNull(), 0).otherwise(F.size(F.array_distinct(gone))).cast("long")
    total = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    return out.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], removed.alias("__removed"), (total - removed).alias("__kept"))


def query(docs: DataFrame) -> DataFrame:
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("__removed").alias("n_removed"), F.col("__kept").alias("n_kept"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, text, i - 1 AS line, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS w
  FROM (SELECT doc_id, text, l, unnest(range(1, len(l) - 1)) AS i FROM d WHERE len(l) >= 3)),
f AS (SELECT w, min({'d': doc_id, 'line': line}) AS f FROM w GROUP BY w),
later AS (SELECT doc_id, text, line FROM w JOIN f USING (w) WHERE doc_id IS DISTINCT FROM f.d OR line >= f.line + 3),
gone AS (SELECT DISTINCT doc_id, text, line + j AS line FROM later, (SELECT unnest([0, 1, 2]) AS j)),
g AS (SELECT doc_id AS gd, text AS gt, list(line) AS g FROM gone GROUP BY doc_id, text),
k AS (
  SELECT d.doc_id, d.text, d.l, coalesce(len(g), 0) AS n_removed,
         list_filter(list_transform(range(0, len(l)), lambda i: {'i': i, 'x': l[i + 1]}), lambda p: g IS NULL OR NOT list_contains(g, p.i)) AS kept
  FROM d LEFT JOIN g ON d.doc_id IS NOT DISTINCT FROM gd AND d.text = gt)
SELECT o.doc_id, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(len(kept), 0) AS BIGINT) AS n_kept,
       CASE WHEN o.text IS NOT NULL THEN sha256(coalesce(array_to_string(list_transform(kept, lambda p: p.x), chr(10)), '')) END AS kept_sha256
FROM documents o LEFT JOIN k ON o.doc_id IS NOT DISTINCT FROM k.doc_id AND o.text = k.text
"""
