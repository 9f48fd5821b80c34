"""Document fingerprints by consistent weighted sampling.

A text's terms are its lower-case words, weighted by how often they occur. For each of ``SAMPLES``
samples every term draws r, c ~ Gamma(2, 1) and b ~ U(0, 1), the same for that term in every text, and
gives ``ln a = ln c - r (t - b + 1)`` with ``t = floor(ln(weight) / r + b)``; the sample is the
(term, t) of the smallest ``ln a``. Two texts agree in a sample with a probability of their generalised
Jaccard similarity, sum(min) / sum(max) of weights, so the share of equal samples estimates it.

Draws come from two tables of ``ROWS`` rows, of (r, b) and of c, picked by different bits of the term's
hash: ``ROWS`` squared combinations, a few MB whatever the data, so broadcasting them has a fixed bound.
Only DataFrame functions are used. Documents are dealt once, in blocks of neighbouring ids; the windows
and aggregations that follow keep that partitioning, so text is shuffled a single time.

Defined results: a null text is empty; texts without a word share the fingerprint of ``f`` digits;
rows with one doc_id follow each other by text; null ids come last, before the order starts anew; a
single document is its own next; equal levels of a sample go to the smallest identity; very long texts count
whole, by the terms they have; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_of

SAMPLES, ROWS = 64, 4096
#: Ids are counted over at most so many cells of equal width, of which blocks are made.
CELLS = 8192
#: Text in a block; a block is what one window partition holds.
BLOCK_BYTES = 8 << 20
LOW32 = 0xFFFFFFFF


def _uniform(row: Column, k: Column, which: int) -> Column:
    return (F.xxhash64(row, k, F.lit(which)).bitwiseAND(F.lit(LOW32)) + F.lit(0.5)) / F.lit(2.0**32)


def draws(spark: SparkSession, samples: int = SAMPLES, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """The tables (row, r, b) and (row, ln c), each with an array of ``samples`` values."""
    row = F.col("id")
    each = lambda f: F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: f(k).cast("float"))
    gamma = lambda k, a, b: -F.log(_uniform(row, k, a) * _uniform(row, k, b))
    ids = spark.range(rows)
    first = ids.select(row.alias("row_rb"), each(lambda k: gamma(k, 1, 2)).alias("r"), each(lambda k: _uniform(row, k, 3)).alias("b"))
    second = ids.select(row.alias("row_c"), each(lambda k: F.log(gamma(k, 4, 5))).alias("lc"))
    return F.broadcast(first), F.broadcast(second)


def terms(text: Column) -> Column:
    """Hashes of the words, in ascending order, repeated as often as they occur."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def sample_columns(samples: int = SAMPLES) -> list[Column]:
    """For each sample the smallest (ln a, identity of term and t) as one long; needs h, w, r, b, lc."""
    out = []
    for k in range(samples):
        r, b, lc = (F.get(F.col(c), F.lit(k)).cast("double") for c in ("r", "b", "lc"))
        t = F.floor(F.log(F.col("w")) / r + b)
        level = F.floor((lc - r * (t.cast("double") - b + 1) + 128) * F.lit(float(1 << 23)))
        level = F.least(F.greatest(level, F.lit(0)), F.lit((1 << 31) - 1))
        ident = (F.col("h").bitwiseAND(F.lit(LOW32)) + t * 40503).bitwiseAND(F.lit(LOW32))
        out.append(F.min(level * F.lit(1 << 32) + ident).alias(f"v{k}"))
    return out


def signature(samples: int = SAMPLES) -> Column:
    """The samples' identities as an array; -1 where a text has no word."""
    return F.array(*[F.coalesce(F.col(f"v{k}").bitwiseAND(F.lit(LOW32)), F.lit(-1).cast("bigint")) for k in range(samples)])


def weighted(sorted_terms: str) -> Column:
    """Array of (h, w) of an array column of ascending hashes: each term and its count."""
    given = F.col(sorted_terms)
    ends = F.filter(F.sequence(F.lit(1), F.size(given)), lambda i: F.coalesce(F.get(given, i) != F.get(given, i - 1), F.lit(True)))
    ends = F.when(F.size(given) > 0, ends).otherwise(F.array().cast("array<int>"))
    return F.transform(ends, lambda i: F.struct(F.get(given, i - 1).alias("h"), i.alias("end")))


def sampled(rows: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``signature`` for each row's text; rows are told apart by their keys.

    The aggregation adds no exchange where ``rows`` are already partitioned by some of the keys.
    """
    first, second = draws(rows.sparkSession, samples)
    rows = rows.withColumn("sorted_terms", terms(F.col(text))).select(*keys, "sorted_terms")
    rows = rows.withColumn("runs", weighted("sorted_terms")).select(*keys, "runs")
    counted = F.transform("runs", lambda x, i: F.struct(x["h"].alias("h"), (x["end"] - F.coalesce(F.get(F.col("runs"), i - 1)["end"], F.lit(0))).alias("w")))
    rows = rows.withColumn("counted", counted).select(*keys, F.explode_outer("counted").alias("x"))
    rows = rows.select(*keys, F.col("x.h").alias("h"), F.col("x.w").cast("double").alias("w"))
    rows = rows.withColumns({
        "at_rb": F.shiftrightunsigned("h", 32) % F.lit(ROWS),
        "at_c": F.shiftrightunsigned("h", 46) % F.lit(ROWS),
    })
    rows = rows.join(first, F.col("at_rb") == F.col("row_rb"), "left").join(second, F.col("at_c") == F.col("row_c"), "left")
    return rows.groupBy(*keys).agg(*sample_columns(samples)).select(*keys, signature(samples).alias("signature"))


def as_text(found: Column) -> Column:
    """A signature as a string of 8 hexadecimal digits a sample."""
    return F.array_join(F.transform(found, lambda x: F.lower(F.substring(F.lpad(F.hex(x), 16, "0"), -8, 8))), "")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples: the estimate of generalised Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(samples))


def _blocks(docs: DataFrame) -> tuple[DataFrame, Column, int | None, int]:
    """Cells with their block, the block above and the block's largest id; the cell of an id; largest id."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = (low or 0), high
    width = max(1, -(-((high if high is not None else low) - low + 1) // CELLS))
    # Ids may lie farther apart than a long can tell.
    cell = F.expr(f"CAST((CAST(doc_id AS DECIMAL(20,0)) - CAST('{low}' AS DECIMAL(20,0))) div CAST('{width}' AS DECIMAL(20,0)) AS BIGINT)")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    found = docs.select(F.coalesce(cell, F.lit(0)).cast("bigint").alias("cell"), "doc_id", size.alias("size"))
    found = found.groupBy("cell").agg(F.sum("size").alias("size"), F.max("doc_id").alias("top")).collect()  # CELLS rows at most
    block, filled, rows, tops = 0, 0, [], {}
    for x in sorted(found, key=lambda r: r["cell"]):
        if filled >= BLOCK_BYTES:
            block, filled = block + 1, 0
        filled += x["size"]
        rows.append((x["cell"], block))
        if x["top"] is not None:
            tops[block] = x["top"]
    out = [(c, b, b + 1 if b < block else None, tops.get(b)) for c, b in rows]
    made = docs.sparkSession.createDataFrame(out, "cell bigint, block bigint, above bigint, top bigint")
    return F.broadcast(made), F.coalesce(cell, F.lit(0)).cast("bigint"), high, len(out)


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form, and likeness to that and to the next document.

    In the edited form the last half of the characters gives way to as many from the start of the next
    document, in descending order of doc_id; after the last comes the first.
    """
    docs = docs.select("doc_id", text_of().alias("text"))
    cells, cell, high, _ = _blocks(docs)
    rows = docs.withColumn("cell", cell).join(cells, "cell", "left")
    # The first document of each block is also the one that follows the block above, and the very first follows the last.
    place = lambda block, rank: F.struct(block.cast("bigint").alias("block"), F.lit(rank).alias("rank"))
    nothing = F.array().cast("array<struct<block:bigint,rank:int>>")
    places = F.concat(
        F.array(place(F.col("block"), 0)),
        F.when(F.col("above").isNotNull() & F.col("doc_id").eqNullSafe(F.col("top")), F.array(place(F.col("above"), 1))).otherwise(nothing),
        F.when(F.col("doc_id").eqNullSafe(F.lit(high)), F.array(place(F.lit(0), 2))).otherwise(nothing),
    )
    rows = rows.select("doc_id", "text", F.explode(places).alias("place")).select("doc_id", "text", "place.block", "place.rank")
    order = Window.partitionBy("block").orderBy("rank", F.desc_nulls_last("doc_id"), "text")
    rows = rows.select("block", F.row_number().over(order).alias("at"), "rank", "doc_id", "text", F.lead("text").over(order).alias("next_text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.coalesce(F.substr("next_text", F.lit(1), half), F.lit("")))
    rows = rows.withColumn("edited", edited)
    side = lambda i, text: F.struct(F.lit(i).alias("side"), F.col(text).alias("text"))
    sides = F.when(F.col("rank") == 0, F.array(side(0, "text"), side(1, "edited"))).otherwise(F.array(side(0, "text")))
    rows = rows.select(
        "block", "at", "rank", "doc_id", n.cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.explode(sides).alias("s"),
    ).select("block", "at", "rank", "doc_id", "n_chars", "edited_sha256", "s.side", "s.text")
    keys = ["block", "at", "rank", "doc_id", "n_chars", "edited_sha256", "side"]
    found = sampled(rows, keys, "text")
    around = Window.partitionBy("block").orderBy("at", "side")
    found = found.withColumns({"edited_signature": F.lead("signature", 1).over(around), "next_signature": F.lead("signature", 2).over(around)})
    return found.where((F.col("side") == 0) & (F.col("rank") == 0)).select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("signature")).alias("fingerprint"),
        as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
