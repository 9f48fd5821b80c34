"""Packing documents into sequences, shortest pack first over the histogram of lengths.

Documents are encoded and cut into pieces of the capacity and a rest. The rests' histogram has at most
``capacity`` rows, whatever the data; on it patterns of packs are built: lengths, longest first, go to
the shortest pack they fit, and the counts of the patterns change with them. A pattern
stands for many sequences. Pieces are then numbered within their length and joined to the patterns by
that rank. A length may hold a third of all pieces, so ranks are row numbers within salted parts of a length plus the
number of pieces in the parts before.

Defined results: a null text is empty, its document the end id alone; repeated rows are packed each;
very long texts are encoded whole in their task and cut into as many pieces as they need; ties go by the order columns, then arbitrarily; other columns are carried along by :func:`pack`, whose
own working columns have reserved names; an empty table gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .common import text_of
from .units import encoder_of, small_batches, widened

CAPACITY = 2048
#: Pieces in a salted part of a length, on average.
PART_ROWS = 100_000
#: Pattern rows up to which they are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1 << 16
P = "__pack_"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids`` of every piece; ids as little-endian unsigned 32-bit integers."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, some in small_batches(texts):
                rows = []
                for i, made in enumerate(encoder(some)):
                    ids = widened(made, encoder.kind) + end
                    n = len(ids) // 4
                    whole = n - n % capacity
                    borders = [*range(0, whole + 1, capacity), n]
                    for a, b in zip(borders, borders[1:], strict=False):
                        if b > a:
                            rows.append({"doc_id": names[at + i], "start": a, "length": b - a, "doc_tokens": n, "ids": ids[4 * a : 4 * b]})
                yield pa.RecordBatch.from_pylist(rows, _PIECES)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(cut, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary")


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with the number of packs of each."""
    if any(not 0 < length <= capacity for length in histogram):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    by_space: dict[int, dict[tuple[int, ...], int]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = max((s for s, held in by_space.items() if held and s >= length), default=None)
            if space is None:
                own = by_space.setdefault(capacity - length, {})
                own[(length,)] = own.get((length,), 0) + left
                break
            pattern, count = by_space[space].popitem()
            used = min(count, left)
            if used < count:
                by_space[space][pattern] = count - used
            grown = by_space.setdefault(space - length, {})
            grown[(*pattern, length)] = grown.get((*pattern, length), 0) + used
            left -= used
    return sorted((p, n) for held in by_space.values() for p, n in held.items())


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, pieces a sequence, first sequence, first offset)."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            first = taken.get(length, 0)
            taken[length] = first + each * count
            out.append((length, first, taken[length], each, sequence, offset))
            offset += each * length
        sequence += count
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """``pieces`` (written once, as they are read twice) with ``sequence_id`` and ``offset``."""
    pieces = stage(pieces.drop("sequence_id", "offset"), "pieces")
    histogram = dict(pieces.groupBy("length").count().limit(capacity + 1).collect())
    made = slots(pack_histogram(histogram, capacity))
    parts = max(1, -(-max(histogram.values(), default=1) // PART_ROWS))
    salted = pieces.withColumn(f"{P}part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = salted.groupBy("length", f"{P}part").agg(F.count(F.lit(1)).alias(f"{P}n"))
    before = Window.partitionBy("length").orderBy(f"{P}part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", f"{P}part", F.coalesce(F.sum(f"{P}n").over(before), F.lit(0)).alias(f"{P}before"))
    own = Window.partitionBy("length", f"{P}part").orderBy(*order)
    ranked = salted.withColumn(f"{P}own", F.row_number().over(own)).join(counts, ["length", f"{P}part"])
    ranked = ranked.withColumn(f"{P}rank", F.col(f"{P}before") + F.col(f"{P}own") - 1)
    names = [f"{P}{x}" for x in ("length", "first", "after", "each", "sequence", "offset")]
    table = pieces.sparkSession.createDataFrame(made, ", ".join(f"{n} bigint" for n in names))
    table = F.broadcast(table) if len(made) <= MOST_BROADCAST else table
    here = (F.col("length") == F.col(f"{P}length")) & (F.col(f"{P}rank") >= F.col(f"{P}first")) & (F.col(f"{P}rank") < F.col(f"{P}after"))
    placed = ranked.join(table, here)
    within = F.col(f"{P}rank") - F.col(f"{P}first")
    return placed.select(
        *pieces.columns,
        (F.col(f"{P}sequence") + F.floor(within / F.col(f"{P}each"))).alias("sequence_id"),
        (F.col(f"{P}offset") + within % F.col(f"{P}each") * F.col("length")).alias("offset"),
    )


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """``sequence_id, ids`` of packed pieces with their ids, padded to ``capacity``; a power of two stays as it is."""
    whole = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("held"), F.sum("length").alias("n"))
    ids = F.array_join(F.transform("held", lambda x: F.hex(x["ids"])), "")
    pad = F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(capacity) - F.col("n")).cast("int"))
    power = F.bit_count("n") == 1
    return whole.select("sequence_id", F.unhex(F.when(power, ids).otherwise(F.concat(ids, pad))).alias("ids"))


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its place and the checksum of its ids, without the ids."""
    if not os.path.exists(tokenizer):
        raise FileNotFoundError(tokenizer)
    pieces = token_pieces(docs, tokenizer, end_id, capacity)
    return pack(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), capacity)
