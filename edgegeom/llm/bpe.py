"""Byte-level BPE by the ranks of a tiktoken file, over overlapping chunks of texts.

Long texts are cut into chunks of ``CHUNK`` characters that overlap by ``OVERLAP`` on both sides, so
one long text is the work of many tasks. Each chunk is divided into pre-tokens from where it starts,
in its overlap, which may be out of step with the true division. Two divisions that share one border
agree from there on, as a match depends only on where it starts and what follows. So the first border
in the overlap that a chunk shares with the chunk before it is where its own pre-tokens start and the
other's end, if the chunk before was itself in step by then. The pieces between these borders are
encoded, and the ids of a text are its pieces' in order. Should two chunks not meet in an overlap (one
pre-token reaches over all of it), the text is divided as a whole. Texts of one chunk take no part in
the stitching and are not shuffled.

Decoding puts the raw bytes of the ids together.

Defined results: a null text is empty and has no ids; repeated rows are encoded each; columns other
than the key are not read; an empty table gives no rows. The key must tell multi-chunk texts apart
only within a call: rows are numbered, so equal doc_ids do no harm.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of
from .units import small_batches

CHUNK, OVERLAP = 1 << 16, 1 << 10


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("from file", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def encode_pieces(coder, text: str) -> bytes:
    """Ids of a text that starts and ends at pre-token borders, as little-endian 32-bit integers."""
    return coder.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def borders(pattern: regex.Pattern, text: str, low: int, high: int) -> list[int]:
    """Starts of pre-tokens in [low, high), and the end of the last, when matching starts at 0."""
    out, at = [], 0
    for m in pattern.finditer(text):
        at = m.start()
        if at >= high:
            return out
        if at >= low:
            out.append(at)
    return out


def _chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Rows ``row, doc_id, k, chunks, from, text``: chunk k with its overlaps; ``from`` is where it starts."""
    n = F.length("text")
    count = F.ceil(n / chunk).cast("int")
    rows = docs.select("row", "doc_id", "text", count.alias("chunks"), F.explode(F.sequence(F.lit(0), count - 1)).alias("k"))
    start = F.greatest(F.col("k") * chunk - overlap, F.lit(0))
    stop = F.least((F.col("k") + 1) * chunk + overlap, n)
    return rows.select("row", "doc_id", "k", "chunks", start.alias("from"), F.substr("text", start + 1, stop - start).alias("text"))


def _zones(pattern_text: str, chunk: int, overlap: int):
    """Borders of a chunk in its first and last overlap, in characters of the text."""
    def zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = regex.compile(pattern_text)
        for batch in batches:
            heads, tails = [], []
            for k, start, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                found = np.array(borders(pattern, text, 0, len(text)), dtype=np.int64) + start
                # A border counts where a match from it sees all it could see: not in the cut-off end.
                found = found[: max(0, np.searchsorted(found, start + len(text)) - 1)]
                first, last = k * chunk, (k + 1) * chunk
                heads.append(found[(found > start) & (found < first + overlap)] if k else found[:0])
                tails.append(found[found >= last - overlap])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], ["row", "k", "head", "tail"]
            )

    return zones


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, ids`` of every text; ids are little-endian unsigned 32-bit integers."""
    docs = docs.select("doc_id", text_of().alias("text"))
    longer = F.length("text") > chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path, pattern)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            for at, some in small_batches(texts, 512):
                made = [encode_pieces(coder, t) for t in some]
                yield pa.RecordBatch.from_arrays([names.slice(at, len(some)), pa.array(made, pa.binary())], ["doc_id", "ids"])

    short = docs.where(~longer).mapInArrow(whole, "doc_id bigint, ids binary")
    rows = docs.where(longer).select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    again = Window.partitionBy("row", "doc_id").orderBy("row")
    # Copies of a row are numbered; long texts are spread over all tasks before they are cut.
    rows = rows.withColumn("copy", F.row_number().over(again)).select(F.struct("row", "doc_id", "copy").alias("row"), "doc_id", "text")
    chunks = _chunks(rows, chunk, overlap)
    kind = "row struct<row:bigint,doc_id:bigint,copy:int>"
    zones = chunks.select("row", "k", "from", "text").mapInArrow(_zones(pattern, chunk, overlap), f"{kind}, k int, head array<bigint>, tail array<bigint>")
    along = Window.partitionBy("row").orderBy("k")
    met = F.array_min(F.array_intersect("head", F.lag("tail").over(along)))
    zones = zones.select("row", "k", F.when(F.col("k") == 0, F.lit(0).cast("bigint")).otherwise(met).alias("start"))
    zones = zones.select("row", "k", "start", F.lead("start").over(along).alias("stop"), F.max(F.col("start").isNull()).over(Window.partitionBy("row")).alias("apart"))
    pieces = chunks.join(zones, ["row", "k"])
    inside = F.substr("text", (F.col("start") - F.col("from") + 1).cast("int"), (F.coalesce("stop", F.col("from") + F.length("text")) - F.col("start")).cast("int"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path, pattern)
        for batch in batches:
            made = [encode_pieces(coder, t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["row", "k", "ids"])

    made = pieces.where(~F.col("apart")).select("row", "k", inside.alias("text")).mapInArrow(part, f"{kind}, k int, ids binary")
    made = made.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("held"))
    stitched = made.select(F.col("row.doc_id").alias("doc_id"), F.unhex(F.array_join(F.transform("held", lambda x: F.hex(x["ids"])), "")).alias("ids"))
    apart = zones.where("apart").select("row").distinct()
    rest = rows.join(apart, "row", "left_semi").select("doc_id", "text").mapInArrow(whole, "doc_id bigint, ids binary")
    return short.unionByName(stitched).unionByName(rest)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ids."""
    kept = encoded.drop("decoded")
    at = kept.columns.index("ids")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for raw, i in ranks.items():
            table[i] = raw
        for batch in batches:
            for some in range(0, batch.num_rows, 256):
                part = batch.slice(some, 256)
                made = [b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=[*part.schema.names, "decoded"])

    return kept.mapInArrow(back, kept.withColumn("decoded", F.lit(None).cast("binary")).schema)
