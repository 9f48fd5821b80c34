"""Registered queries of ranked lexical search and the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import factorisation, lexical
from .common import table

#: Documents returned for an item.
TOP = 10


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), TOP)
    return found.select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS ts FROM benchmark),
stats AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
asked AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(ts) AS term FROM b) GROUP BY ALL),
held AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, stats GROUP BY term, n_docs),
lengths AS (SELECT r, doc_id, {lexical.BASE} + ({lexical.SLOPE} * len(ts) * n_docs) // n_terms AS m FROM d, stats),
scored AS (
  SELECT i, item_id, doc_id, r, sum(times * w * (({lexical.UNIT} * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN lengths USING (r) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""

def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = factorisation.fit(docs.where(~held_out), table(spark, sf_dir, "labels"))
    return factorisation.predict(docs.withColumn("held_out", held_out), model).select("doc_id", "held_out", "score", "predicted")


QUERIES = {f.__name__: f for f in (op11_ranked_lexical_search, op12_quality_classifier)}
SQL = {"op11_ranked_lexical_search": OP11_SQL}
