"""N-gram Jaccard join by MinHash banding.

1. Every text becomes its set of word shingles, a digest of that set and ``bands`` hashes of ``rows``
   minima each, chosen by :func:`choose_bands` so that a pair at the threshold meets in some band with
   the wanted probability. Texts of equal sets are one node, counted by an aggregation with partial
   sums; from here on copies cost nothing.
2. Nodes are shuffled on band hashes; the nodes of a band are linked to its least one, and the connected
   parts of these links are the candidates. A part is verified as a whole, each pair of its nodes that share
   a band once, or bucket by bucket, each pair in the first band it shares: whichever is fewer pairs. A group
   of near copies is in many equal buckets and goes as a whole; a chain of texts that hardly resemble
   each other is a part of any length with small buckets, and its work stays linear. What is verified together
   is dealt over chunks of ``CHUNK`` nodes, and every pair of chunks is a block that one task takes: pairs are
   compared on their full shingle sets. A block returns per node the number of its links and one link of a
   spanning forest, so pairs are never written and a group of any size needs bounded memory.
3. Connected components of the verified links are the classes.

Defined results: a text without a word (null, empty) is linked to nothing and is its own class; a text
of fewer words than a shingle has is one shingle; repeated rows are copies, also of the same doc_id; very
long texts count whole, a shingle set being one value; a
null doc_id is a document like another, and is a class's id only if all its ids are null; classes of
equal least ids share the ``class_id`` and differ in ``root``; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .common import text_of
from .components import connected
from .shingles import WIDTH, Shingler, mix
from .streams import sorted_groups

THRESHOLD = 0.8
#: Wanted probability that a pair at the threshold becomes a candidate, and the most hashes to spend on it.
RECALL, MOST_HASHES = 0.9999, 128
#: Nodes of a candidate part that one side of a block holds.
CHUNK = 256
#: Columns that tell blocks apart; the band of a group that is a whole part.
KEYS, WHOLE = ["band", "part", "low", "high"], -1
#: Shared shingles that one product of a block's incidence matrix takes.
SLAB = 4096


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective rows for which enough bands fit into ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows > most:
            break
        best = bands, rows
    return best or (most, 1)


def _band_hashes(grams: np.ndarray, seeds: np.ndarray, rows: int) -> np.ndarray:
    """Hash of each band's minima; the minima are those of multiply-mixed shingles."""
    least = np.empty(len(seeds), dtype=np.uint64)
    for at in range(0, len(seeds), 8):
        x = grams[None, :] * seeds[at : at + 8, None]
        least[at : at + 8] = (x ^ (x >> np.uint64(32))).min(axis=1)
    total = np.arange(1, len(seeds) // rows + 1, dtype=np.uint64)
    for i in range(rows):
        total = mix(total + least[i::rows])
    return total


def signatures(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """``doc_id, text_hash, n_grams, digest, bands`` of each text; bands is a packed array of longs."""
    bands, rows = choose_bands(threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        for batch in batches:
            n, digests, packed = [], [], []
            for text in batch.column(2).to_pylist():
                grams = shingler(text)
                n.append(len(grams))
                digests.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                packed.append(_band_hashes(grams, seeds, rows).view(np.int64) if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(digests, pa.binary()), pa.array(packed, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_grams", "digest", "bands"],
            )

    given = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    return given.mapInArrow(sign, "doc_id bigint, text_hash bigint, n_grams int, digest binary, bands array<bigint>")


def _links(left: list[dict], right: list[dict] | None, threshold: float, band: int = WHOLE) -> list[tuple[int, int]]:
    """Index pairs over ``left + right`` that reach the threshold and share a band, or ``band`` and none before it."""
    rows = left + (right or [])
    sets = [np.frombuffer(r["grams"], dtype=np.uint64) for r in rows]
    bands = np.array([r["bands"] for r in rows])
    split = len(left) if right else len(rows)
    met = np.zeros((split, len(rows)), dtype=bool)
    for k in range(bands.shape[1] if band == WHOLE else band):
        met |= bands[:split, k][:, None] == bands[None, :, k]
    if band != WHOLE:
        met = ~met
    if right:
        met[:, :split] = False
    else:
        met = np.triu(met, 1)
    if not met.any():
        return []
    values, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    shared = (times > 1)[inverse]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[shared]
    column = rank[inverse[shared]]
    common = np.zeros((split, len(rows)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(rank[-1]) + 1 if len(rank) else 0, SLAB):
        lo, hi = np.searchsorted(column, [at, at + SLAB])
        slab = np.zeros((len(rows), SLAB), dtype=np.float32)
        slab[owner[lo:hi], column[lo:hi] - at] = 1
        common += slab[:split] @ slab.T
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    union = sizes[:split, None] + sizes[None, :] - common
    return list(zip(*np.nonzero(met & (common >= threshold * union)), strict=True))


def _verify(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, links, roots = [], [], []

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(links, pa.int64()), pa.array(roots, pa.int64())], ["node", "links", "root"])
            for x in (nodes, links, roots):
                x.clear()
            return out

        for group in sorted_groups(batches, KEYS):
            rows = [r for i, r in enumerate(group) if not i or r["node"] != group[i - 1]["node"]]
            inside = rows[0]["low"] == rows[0]["high"]
            left = rows if inside else [r for r in rows if r["chunk"] == r["low"]]
            right = None if inside else [r for r in rows if r["chunk"] != r["low"]]
            if not left or (not inside and not right):
                continue
            all_rows = left + (right or [])
            parent, count = list(range(len(all_rows))), [0] * len(all_rows)

            def top(i: int, parent: list[int] = parent) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for i, j in _links(left, right, threshold, rows[0]["band"]):
                count[i] += all_rows[j]["copies"]
                count[j] += all_rows[i]["copies"]
                a, b = top(i), top(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            for i, n in enumerate(count):
                if n:
                    nodes.append(all_rows[i]["node"])
                    links.append(n)
                    roots.append(all_rows[top(i)]["node"])
            if len(nodes) > 10_000:
                yield made()
        yield made()

    return verify


def groups(parts: DataFrame, buckets: DataFrame, chunk: int) -> DataFrame:
    """``node, groups``: what each node of ``parts(node, part)`` is verified in, as an array of (band, part, size).

    ``buckets`` is ``(node, place, band, n)``, a row for each band of a node that n > 1 nodes have. A part of
    one block, or of no more pairs than its buckets have together, is one group, with ``WHOLE`` for its band.
    """
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    # A bucket of n nodes adds n for each of them.
    split = buckets.join(parts, "node").groupBy("part").agg(F.sum("n").alias("pairs"))
    sizes = stage(sizes.join(split, "part").withColumn("whole", (F.col("size") <= chunk) | (F.col("size") * F.col("size") <= F.col("pairs"))), "part-sizes")
    placed = parts.join(sizes, "part")
    whole = placed.where("whole").select("node", F.array(F.struct(F.lit(WHOLE).alias("band"), "part", "size")).alias("groups"))
    apart = buckets.join(placed.where("not whole").select("node"), "node").groupBy("node").agg(
        F.collect_list(F.struct(F.col("place").alias("band"), F.col("band").alias("part"), F.col("n").alias("size"))).alias("groups"))
    return whole.union(apart)


def _blocks(docs: DataFrame, classes: DataFrame, found: DataFrame, width: int, chunk: int) -> DataFrame:
    """A row for each node and block of its groups, with the node's shingles."""
    wanted = found.join(classes, "node").select(
        F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"), "groups", "node", "copies", "bands"
    )
    texts = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    met = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash")))
    met = met.select("groups", "node", "copies", "bands", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            made = [shingler(t).tobytes() for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(made, pa.binary())], [*batch.schema.names[:4], "grams"])

    rows = met.mapInArrow(grams, "groups array<struct<band:int,part:bigint,size:bigint>>, node bigint, copies bigint, bands array<bigint>, grams binary")
    rows = rows.select(F.inline("groups"), "node", "copies", "bands", "grams")
    chunks = F.ceil(F.col("size") / chunk).cast("int")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return rows.select("band", "part", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "node", "copies", "bands", "grams")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """One row per document: ``doc_id, class_id, n_copies, n_links, text_hash, root``.

    ``class_id`` is the least doc_id of the documents that links connect, and only their label; ``root``
    is a number of these documents alone, null for a text without a word. ``n_links`` is the number of
    other documents of at least the threshold, ``n_copies`` that of documents of the same shingle set.
    """
    signed = stage(signatures(docs, threshold, width), "signatures")
    classes = signed.where("n_grams > 0").groupBy("digest").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands")
    )
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bands = classes.select("node", F.posexplode("bands").alias("place", "band"))
    least = stage(bands.groupBy("band").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1"), "least")
    buckets = stage(bands.join(least, "band").select("node", "place", "band", "n", "v"), "buckets")
    met = connected(buckets.select(F.col("node").alias("u"), "v"), "candidates")
    parts = met.select("node", F.col("root").alias("part")).union(met.select("root", "root").distinct())
    found = groups(parts, buckets.drop("v"), chunk)
    blocks = _blocks(docs, classes, found, width, chunk).repartition(*KEYS).sortWithinPartitions(*KEYS, "node")
    found = stage(blocks.mapInArrow(_verify(threshold), "node bigint, links bigint, root bigint"), "links")
    roots = connected(found.select(F.col("node").alias("u"), F.col("root").alias("v")), "classes")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("digest", "node", "copies", "least_id").join(roots, "node", "left").join(links, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min("least_id").alias("class_id"))
    named = named.join(first, "root").select(
        "digest", "class_id", "root", F.col("copies").alias("n_copies"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    alone = F.col("n_copies").isNull()
    return signed.join(named, "digest", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_copies", F.lit(1).cast("bigint")).alias("n_copies"),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        "text_hash",
        "root",
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """``docs`` with one document of each class: that of the least doc_id, of its rows the least text hash."""
    found = jaccard_join(docs, threshold, width)
    kept = found.groupBy("root", F.when(F.col("root").isNull(), F.struct("doc_id", "text_hash")).alias("own")).agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    kept = kept.select(F.col("first.doc_id").alias("__kept_id"), F.col("first.text_hash").alias("__kept_hash"))
    same = docs["doc_id"].eqNullSafe(kept["__kept_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == kept["__kept_hash"])
    once = docs.join(kept, same, "left_semi")
    window = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(text_of())]
    return once.withColumns({"__kept_id": window[0], "__kept_hash": window[1]}).dropDuplicates(["__kept_id", "__kept_hash"]).drop("__kept_id", "__kept_hash")
