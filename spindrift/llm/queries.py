"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, bpe, bwt, jaccard, language, linededup, matroska, mixing, periodic, topk, toxicity, unigram, warc
from .common import table


def op1_topk(spark, sf_dir):
    return topk.query(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark, sf_dir):
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_tokens(spark, sf_dir):
    return unigram.query(table(spark, sf_dir, "documents"))


def op4_matroska(spark, sf_dir):
    return matroska.query(table(spark, sf_dir, "documents"))


def op5_bwt(spark, sf_dir):
    return bwt.query(table(spark, sf_dir, "documents"))


def op6_warc(spark, sf_dir):
    return warc.query(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_lines(spark, sf_dir):
    return linededup.query(table(spark, sf_dir, "documents"))


def op8_bpe(spark, sf_dir):
    return bpe.query(table(spark, sf_dir, "documents"))


def op9_jaccard(spark, sf_dir):
    return jaccard.query(table(spark, sf_dir, "documents"))


def op10_mixing(spark, sf_dir):
    return mixing.query(table(spark, sf_dir, "documents"))


def op11_language(spark, sf_dir):
    return language.query(table(spark, sf_dir, "documents"))


def op12_periodic(spark, sf_dir):
    return periodic.query(table(spark, sf_dir, "documents"))


def op13_alignment(spark, sf_dir):
    return alignment.query(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_topk": op1_topk,
    "op2_toxicity": op2_toxicity,
    "op3_tokens": op3_tokens,
    "op4_matroska": op4_matroska,
    "op5_bwt": op5_bwt,
    "op6_warc": op6_warc,
    "op7_lines": op7_lines,
    "op8_bpe": op8_bpe,
    "op9_jaccard": op9_jaccard,
    "op10_mixing": op10_mixing,
    "op11_language": op11_language,
    "op12_periodic": op12_periodic,
    "op13_alignment": op13_alignment,
}
SQL: dict[str, str] = {"op1_topk": topk.SQL, "op6_warc": warc.SQL, "op7_lines": linededup.SQL}
