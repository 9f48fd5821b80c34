"""Registered query of the conversation prefix trie."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import stage
from . import prefix_trie
from .common import table

#: Conversations of one block of ids share the first turns of its first; at most SHARED - 1 of them.
IDS, SHARED = 100, 6


def rebuilt_turns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and all their ids.

    A conversation's first h turns are those of the conversation that opens its block of ids, and its own
    first h go; the remainder of a negative id is negative, as in SQL.
    """
    turns = stage(prefix_trie.ordered_turns(rows), "ordered")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    opener = F.col("conv_id") - F.col("conv_id") % IDS
    convs = stage(turns.select("conv_id").distinct(), "conversations")
    heads = turns.where((F.col("conv_id") % IDS == 0) & (F.col("position") < SHARED)).withColumnRenamed("conv_id", "opener")
    shared = convs.select("conv_id", opener.alias("opener"), h.alias("h")).join(heads, "opener").where("position <= h")
    lengths = heads.groupBy("opener").agg(F.max("position").alias("n"))
    own = turns.withColumns({"opener": opener, "h": h}).where("position > h").join(lengths, "opener", "left")
    place = F.col("position") - F.col("h") + F.least("h", F.coalesce("n", F.lit(0)))
    made = shared.select("conv_id", "position", "name", "n_chars").union(own.select("conv_id", place.alias("position"), "name", "n_chars"))
    return stage(made, "rebuilt"), convs


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ends = prefix_trie.prefix_trie(*rebuilt_turns(table(spark, sf_dir, "conversations")))
    none = F.lit(hashlib.sha256().hexdigest())
    out = nodes.join(prefix_trie.ends_digests(ends), ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


# The remainder of an id's checksum, bit by bit: SQL has no function for it.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
    lambda x, byte: list_reduce(list_concat([xor(x, byte)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda b, i: xor(b >> 1, 3988292384::UBIGINT * (b & 1)))))"""
OP13_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % {IDS} AS opener, ({_CRC32} % {SHARED})::BIGINT AS h FROM (SELECT DISTINCT conv_id FROM t)),
lengths AS (SELECT conv_id, count(*) AS n FROM t GROUP BY ALL),
turns AS (
  SELECT c.conv_id, t.i AS d, sha256(role) || sha256(text) AS name, length(text) AS n_chars FROM c JOIN t ON t.conv_id = c.opener AND t.i <= c.h
  UNION ALL
  SELECT c.conv_id, t.i - c.h + least(c.h, coalesce(n, 0)), sha256(role) || sha256(text), length(text)
  FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h LEFT JOIN lengths l ON l.conv_id = c.opener),
paths AS MATERIALIZED (
  SELECT conv_id, d, string_agg(name, '') OVER (PARTITION BY conv_id ORDER BY d) AS prefix, n_chars FROM turns
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
nodes AS MATERIALIZED (SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, min(n_chars) AS n_chars FROM paths GROUP BY ALL),
along AS MATERIALIZED (SELECT p.conv_id AS member, p.d, n.conv_id FROM paths p JOIN nodes n ON n.d = p.d AND n.prefix = p.prefix),
linked AS MATERIALIZED (
  SELECT n.*, a.conv_id AS parent, (SELECT count(DISTINCT b.conv_id) FROM along b JOIN along o ON o.member = b.member AND o.d = n.d AND o.conv_id = n.conv_id WHERE b.d = n.d + 1) AS n_children
  FROM nodes n LEFT JOIN along a ON a.member = n.conv_id AND a.d = n.d - 1),
under AS (
  SELECT u.conv_id, u.d, sum((l.n_children = 0)::BIGINT) AS n_leaves, sum((l.n_convs - 1) * l.n_chars) AS saved
  FROM linked l JOIN along u ON u.member = l.conv_id AND u.d <= l.d GROUP BY ALL),
ends AS (
  SELECT conv_id, d, sha256(string_agg(member::VARCHAR, ',' ORDER BY member)) AS ends
  FROM along JOIN (SELECT member, max(d) AS d FROM along GROUP BY ALL) USING (member, d) GROUP BY ALL)
SELECT l.conv_id, l.d::BIGINT AS depth, l.parent AS parent_conv_id, l.n_convs::BIGINT AS n_convs, l.n_children::BIGINT AS n_children,
  u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM linked l JOIN under u USING (conv_id, d) LEFT JOIN ends e USING (conv_id, d)
"""

QUERIES = {f.__name__: f for f in (op13_conversation_prefix_trie,)}
SQL = {"op13_conversation_prefix_trie": OP13_SQL}
