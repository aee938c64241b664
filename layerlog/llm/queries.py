"""Queries of the text operators, on whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import table
from . import lookalike, mixing, tokens


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents").select("doc_id", "text"), tokens.vocabulary_path(spark))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Round trip: the texts that decoding the ids gives back; null comes back as ''."""
    return tokens.decode_corpus(p8_ids(spark, d), tokens.vocabulary_path(spark))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, same): whether the count of tokens is the number of ids."""
    ids = p8_ids(spark, d).select("doc_id", F.size("ids").cast("long").alias("n"))
    counts = tokens.count_tokens(table(spark, d, "documents").select("doc_id", "text"), tokens.vocabulary_path(spark))
    return ids.join(counts, "doc_id").select("doc_id", (F.col("n") == F.col("tokens")).alias("same"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents").select("doc_id", "source", "text"), table(spark, d, "mix_targets"), tokens.vocabulary_path(spark))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(cut(p9_mixture(spark, d)), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, d, "documents").select("doc_id", "text"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_classes(table(spark, d, "documents").select("doc_id", "text"))


def p10_text(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent(table(spark, d, "documents").select("doc_id", "text"))


QUERIES = {"p8_ids": p8_ids, "p8_decoded": p8_decoded, "p8_counts": p8_counts, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_classes": p10_classes, "p10_text": p10_text}
ORACLES: dict[str, str] = {
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
