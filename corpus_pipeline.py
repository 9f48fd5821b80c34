"""The training-data pipeline: each stage is written as Parquet and read again by the next.

Every stage works on all rows of its predecessor and takes what it learns or counts from these alone.
Nulls: a null text counts as empty and goes at the first stage, having no letter; a null ``lang`` is not
learned from. Repeated rows count as copies, of which one stays. Further columns of ``documents`` are
kept as they are until packing. Empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgegeom.llm import jaccard, language, packing, quality, suffix_dedup
from edgegeom.llm.common import table
from edgegeom.staging import stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, and not farther from every language than its texts are."""
    own = {c: f"own {c}" for c in docs.columns if c in language.RESULTS.fieldNames()}
    labelled = language.predict(docs.withColumnsRenamed(own), language.fit(docs))
    return labelled.where("not rejected").select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near some language's histograms."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join."""
    return jaccard.keep_one(docs).select(*docs.columns)


#: Bytes of a repeated string that the pipeline cuts, and of the grams that find it.
REPEATED_BYTES, REPEATED_GRAM = 250, 80


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that start more than once; ``n_chars`` follows the text.

    A passage counts from about 50 words on, and 50 words of short ones are little more than 250 bytes with
    their spaces; 400 bytes would leave about half of such passages.
    """
    own = {c: f"own {c}" for c in docs.columns if c in suffix_dedup.RESULTS}
    cut = suffix_dedup.remove_repeats(docs.withColumnsRenamed(own), REPEATED_BYTES, REPEATED_GRAM, characters=True)
    text = F.when(F.col("n_removed") > 0, F.decode("kept", "UTF-8")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length(text).cast("bigint")).otherwise(F.col("n_chars"))
    changed = {"text": text, "n_chars": n_chars}
    return cut.select(*[changed[c].alias(c) if c in changed else F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets."""
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("packing", packed),
]
#: Shingle joins, suffix order and tokenizers have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
