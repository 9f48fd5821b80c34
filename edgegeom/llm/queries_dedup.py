"""Registered queries of the near-duplicate join and of suffix-order deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, suffix_dedup
from .common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_join(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_copies", "n_links")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # A span may cut a character; what is left of one is shown as the replacement character.
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op6_suffix_dedup)}
SQL: dict[str, str] = {}
