"""Removal of long byte strings that start more than once, by suffix order.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts somewhere else, in any text or
at another place of the same. The work is exact and split as follows.

1. Equal texts are one, counted; all of a text with copies goes if it has ``LENGTH`` bytes.
2. In every text the least of each run of ``LENGTH - GRAM + 1`` hashed ``GRAM``-byte strings is an
   anchor. The choice depends on the string of ``LENGTH`` bytes alone, so equal strings have equal anchors
   at equal places. Anchors are counted over all texts; those met once can be forgotten.
3. The bytes around each anchor that is met again, all that the strings with this anchor reach, go to
   one task per anchor; every string has one anchor, so a byte travels about four times. There the contexts to the right, and those to the left read backwards, form two
   compact tries; a context becomes the sequence of trie edges on its way, from its left end to its
   right. Two contexts share such an edge only together with all bytes between it and the anchor, so
   suffixes of these sequences compare as the byte strings do, and a few symbols stand for some 540 bytes.
   The suffix order of all sequences (``suffix_order``) puts beside each suffix the one it shares most
   with: their common bytes say from which offset on a string occurs twice.
4. The start ranges found are merged, first in the task, then by parts of ``SPAN`` starts of a text, and
   only then gathered per text and cut out.

Of an anchor met more than ``CHUNK`` times equal contexts are counted first: all strings of those met
again go, and each context is one from here on. The different ones are dealt over chunks; every pair of
chunks is a task, so no task holds more than two chunks, and no pair of contexts is missed.

Defined results: a null text is empty; shorter texts stay whole; very long ones are read
whole in their task, and their contexts are of bounded length; repeated rows are copies; strings
are judged on the input, not on what is left; other columns are kept and those named as the results
replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .common import text_of
from .shingles import mix
from .streams import sorted_groups
from .suffix_order import suffix_order

LENGTH, GRAM = 400, 128
RESULTS = ("kept", "n_bytes", "n_removed", "n_spans")
#: Contexts of an anchor in one chunk.
CHUNK = 4096
#: Starts of one text that are merged together.
SPAN = 1 << 16
#: Odd base of the rolling hash, and random values of the 256 bytes.
BASE = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


class Anchors:
    """Finds the anchors of texts; keeps tables of powers between texts."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.width = length, gram, length - gram + 1
        self._grow(1 << 14)

    def _grow(self, n: int) -> None:
        def powers(base: int) -> np.ndarray:
            factors = np.full(n + 1, base, dtype=np.uint64)
            factors[0] = 1
            return np.cumprod(factors, dtype=np.uint64)

        self.powers, self.inverse = powers(BASE), powers(pow(BASE, -1, 1 << 64))

    def _sliding(self, x: np.ndarray, least) -> np.ndarray:
        """Least (or largest) of every run of ``width`` values, by doubling."""
        span = 1
        while 2 * span <= self.width:
            x = least(x[:-span], x[span:])
            span *= 2
        rest = self.width - span
        return least(x[:-rest], x[rest:]) if rest else x

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash and position of each anchor, and the least and largest offset at which strings have it.

        A string's anchor is the leftmost of its least hashes, so every string has just one.
        """
        n = len(data)
        if n < self.length:
            return np.zeros(0, dtype=np.int64), *(np.zeros(0, dtype=np.int32),) * 3
        if n + 1 > len(self.powers):
            self._grow(2 * n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[np.frombuffer(data, dtype=np.uint8)] * self.powers[:n], dtype=np.uint64, out=sums[1:])
        hashes = mix((sums[self.gram :] - sums[: -self.gram]) * self.inverse[: n - self.gram + 1])
        least = self._sliding(hashes, np.minimum)
        around = np.concatenate([np.zeros(self.width - 1, dtype=np.uint64), least, np.zeros(self.width - 1, dtype=np.uint64)])
        chosen = self._sliding(around, np.maximum) == hashes
        at = np.flatnonzero(chosen)
        own = (np.cumsum(chosen) - chosen)[: len(least)]  # for each string, the first anchor from its start on
        open_ = np.flatnonzero(hashes[at[own]] != least)
        while len(open_):
            own[open_] += 1
            open_ = open_[hashes[at[own[open_]]] != least[open_]]
        ends = np.flatnonzero(np.append(own[1:] != own[:-1], True))
        places = at[own[ends]]
        starts = np.append(0, ends[:-1] + 1)
        return hashes[places].view(np.int64), *(x.astype(np.int32) for x in (places, places - ends, places - starts))


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def trie(strings: list[bytes]) -> tuple[list[int], list[int], list[int]]:
    """Compact trie: depth and parent of each node (0 is the root), and the node where each string ends."""
    depth, parent, ends = [0], [0], [0] * len(strings)
    stack, last = [0], b""
    for i in sorted(range(len(strings)), key=strings.__getitem__):
        own = strings[i]
        shared = _common(last, own)
        below = None
        while depth[stack[-1]] > shared:
            below = stack.pop()
        if depth[stack[-1]] < shared:
            depth.append(shared)
            parent.append(stack[-1])
            parent[below] = len(depth) - 1
            stack.append(len(depth) - 1)
        if len(own) > shared:
            depth.append(len(own))
            parent.append(stack[-1])
            stack.append(len(depth) - 1)
        ends[i], last = stack[-1], own
    return depth, parent, ends


def repeated_offsets(contexts: list[tuple[bytes, bytes]], length: int) -> list[list[tuple[int, int]]]:
    """For each (left, right) context the ranges of offsets a, such that the string of ``length`` bytes
    from a bytes left of the anchor on also is that of another context at the same offset."""
    left = trie([a[::-1] for a, _ in contexts])
    right = trie([b for _, b in contexts])
    shift = len(left[0]) + 1
    symbols: list[int] = []
    spans, weights = [], []
    for a, b in zip(left[2], right[2], strict=True):
        start = len(symbols)
        while a:
            symbols.append(a + 1)
            weights.append(left[0][a] - left[0][left[1][a]])
            a = left[1][a]
        middle, way = len(symbols), []
        while b:
            way.append(b)
            b = right[1][b]
        for b in reversed(way):
            symbols.append(b + shift)
            weights.append(right[0][b] - right[0][right[1][b]])
        spans.append((start, middle, len(symbols)))
        symbols.append(1)  # the end of a context, smaller than all edges
        weights.append(0)
    order = suffix_order(symbols)
    rank = [0] * len(symbols)
    for at, i in enumerate(order):
        rank[i] = at
    sums = [0, *accumulate(weights)]
    most = [0] * len(symbols)
    shared = 0  # symbols shared with the suffix before in order: one less at most from one suffix to the next
    for i in range(len(symbols)):
        if not rank[i]:
            shared = 0
            continue
        j = order[rank[i] - 1]
        while symbols[i + shared] == symbols[j + shared] != 1:
            shared += 1
        total = sums[i + shared] - sums[i]
        most[i], most[j] = max(most[i], total), max(most[j], total)
        shared = max(0, shared - 1)
    out = []
    for start, middle, end in spans:
        found = [(0, 0)] if middle < end and most[middle] >= length else []
        far = sum(weights[start:middle])
        for at in range(start, middle):
            near = far - weights[at]
            low = max(near + 1, length - (most[at] - far))
            if most[at] and low <= far:
                found.append((low, far))
            far = near
        out.append(found)
    return out


_ANCHOR = ("hashes", "places", "lows", "highs")


def _texts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Distinct texts with their digest, number, one doc_id and anchors."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram)
        for batch in batches:
            made = [anchors(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array([m[i] for m in made], pa.list_(pa.int64() if not i else pa.int32())) for i in range(4))],
                ["doc_id", "digest", *_ANCHOR],
            )

    given = docs.select("doc_id", _digest().alias("digest"), text_of().cast("binary").alias("data"))
    found = given.mapInArrow(find, "doc_id bigint, digest binary, hashes array<bigint>, places array<int>, lows array<int>, highs array<int>")
    texts = found.groupBy("digest").agg(
        F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("copies"), F.any_value(F.struct(*_ANCHOR)).alias("x")
    ).select("digest", "rep_id", "copies", "x.*")
    return stage(texts.withColumn("text_no", F.monotonically_increasing_id()), "texts")


def _digest():
    return F.unhex(F.md5(text_of().cast("binary")))


def _contexts(docs: DataFrame, texts: DataFrame, length: int, chunk: int) -> tuple[DataFrame, DataFrame | None]:
    """A row per text, anchor met again and context of it, for every pair of chunks it is in.

    ``places`` are where the text has that context: texts that repeat themselves have it often. The
    second table has the places of contexts met again of anchors met more than ``chunk`` times; in the
    first, such a context is one row without places.
    """
    met = texts.select("text_no", F.explode(F.arrays_zip(*_ANCHOR)).alias("x")).select(
        "text_no", F.col("x.hashes").alias("anchor"), F.col("x.places").alias("place"), F.col("x.lows").alias("low"), F.col("x.highs").alias("high")
    )
    # Written counts leave both sides of the join to be dealt anew, so a hot anchor's rows are split over tasks.
    again = stage(met.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "again")
    met = stage(met.join(again, "anchor"), "met")
    often = F.col("times") > chunk
    few = _cut(docs, texts, met.where(~often), length).select(
        "anchor", F.lit(0).alias("chunk"), F.lit(0).alias("low"), F.lit(0).alias("high"), "text_no", "places", "left", "context"
    )
    if met.where(often).isEmpty():
        return few, None
    many = _cut(docs, texts, met.where(often), length).withColumn("key", F.unhex(F.md5("context")))
    many = stage(many, "contexts")
    same = ["anchor", "left", "key"]
    counted = many.groupBy(*same).agg(
        F.sum(F.size("places")).alias("n"), F.min(F.struct("text_no", F.get("places", F.lit(0)).alias("place"))).alias("one"), F.min("context").alias("context")
    )
    counted = stage(counted, "counted")
    twice = many.select(*same, "text_no", "places", F.length("context").alias("size"))
    twice = twice.join(counted.where("n > 1").select(*same), same).select("text_no", "places", "left", "size")
    sizes = stage(counted.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts")), "sizes")
    chunks = F.ceil(F.col("contexts") / chunk).cast("int")
    # A context met again is only held against others here; its own ranges are those of ``twice``.
    own = F.when(F.col("n") == 1, F.array("one.place")).otherwise(F.array().cast("array<int>"))
    rows = counted.join(sizes, "anchor").select(
        "anchor", F.col("one.text_no").alias("text_no"), own.alias("places"), "left", "context",
        F.pmod(F.xxhash64("left", "key"), chunks).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"),
    ).select("anchor", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "text_no", "places", "left", "context")
    return few.union(rows), twice


def _cut(docs: DataFrame, texts: DataFrame, met: DataFrame, length: int) -> DataFrame:
    """A row per text, anchor and context of ``met``."""
    met = met.groupBy("text_no").agg(F.collect_list(F.struct("anchor", "place", "low", "high")).alias("met"))
    wanted = texts.select("text_no", "digest", "rep_id").join(met, "text_no").withColumnRenamed("digest", "rep_digest")
    given = docs.select("doc_id", _digest().alias("digest"), text_of().cast("binary").alias("data"))
    rows = given.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("digest") == F.col("rep_digest")))
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text_no, data, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own: dict[tuple, list[int]] = {}
                for x in found:
                    at, left = x["place"], x["high"]
                    own.setdefault((x["anchor"], data[at - left : at + length - x["low"]], left), []).append(at)
                for (anchor, context, left), places in own.items():
                    for held, value in zip(out, (anchor, text_no, sorted(places), left, context), strict=True):
                        held.append(value)
                if len(out[0]) > 4096:
                    yield _batch(out)
                    out = [[], [], [], [], []]
            if out[0]:
                yield _batch(out)

    return rows.select("text_no", "data", "met").mapInArrow(cut, "anchor bigint, text_no bigint, places array<int>, left int, context binary")


def _batch(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["anchor", "text_no", "places", "left", "context"])


def _solve(length: int):
    """Ranges of starts of repeated strings, for every occurrence of an anchor in a group."""
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int]] = []
        for group in sorted_groups(batches, ["anchor", "low", "high"]):
            # Rows of one place are the same occurrence; equal contexts are solved once.
            places: dict[tuple[bytes, int], set[tuple[int, int]]] = {}
            for r in group:
                places.setdefault((r["context"], r["left"]), set()).update((r["text_no"], at) for at in r["places"])
            contexts = [(c[:n], c[n:]) for c, n in places]
            found = repeated_offsets(contexts, length) if len(contexts) > 1 else [[]]
            ranges_of: dict[int, list[tuple[int, int]]] = {}
            for (a, b), occurrences, ranges in zip(contexts, places.values(), found, strict=True):
                if len(occurrences) > 1:
                    low = max(0, length - len(b))
                    ranges = [(low, len(a))] if low <= len(a) else []
                for text_no, place in occurrences:
                    ranges_of.setdefault(text_no, []).extend((place - high, place - low) for low, high in ranges)
            for text_no, own in ranges_of.items():
                rows += ((text_no, *x) for x in merged(own))
            if len(rows) > 10_000:
                yield _ranges(rows)
                rows.clear()
        yield _ranges(rows)

    return solve


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of integers, both ends included, as the fewest that cover the same."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _ranges(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    made = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
    return pa.RecordBatch.from_arrays(made, ["text_no", "first", "last"])


def _whole(length: int):
    """Ranges of all strings with the anchor, for contexts met again."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text_no, places, left, size in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                low = max(0, length - (size - left))
                if low <= left:
                    yield _ranges([(text_no, *x) for x in merged((at - left, at - low) for at in places)])

    return whole


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges rows sorted by text, part of the text and first start; only the last range is held."""
    last: tuple | None = None
    for batch in batches:
        rows = []
        for text_no, part, low, high in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if last and last[:2] == (text_no, part) and low <= last[3] + 1:
                last = (*last[:3], max(last[3], high))
            else:
                if last:
                    rows.append((last[0], *last[2:]))
                last = (text_no, part, low, high)
        yield _ranges(rows)
    if last:
        yield _ranges([(last[0], *last[2:])])


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK) -> DataFrame:
    """``digest, rep_id, copies, ranges`` of every distinct text; ranges are of starts of repeated strings."""
    texts = _texts(docs, length, gram)
    keys = ["anchor", "low", "high"]
    rows, twice = _contexts(docs, texts, length, chunk)
    schema = "text_no bigint, first bigint, last bigint"
    found = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_solve(length), schema)
    if twice is not None:
        found = found.union(twice.mapInArrow(_whole(length), schema))
    # A long range stays in the part of its first start; what reaches into the next is merged when it is cut out.
    parts = found.select("text_no", F.floor(F.col("first") / SPAN).alias("part"), "first", "last")
    found = parts.repartition("text_no", "part").sortWithinPartitions("text_no", "part", "first").mapInArrow(_merge, schema)
    found = found.groupBy("text_no").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("ranges"))
    return stage(texts.select("text_no", "digest", "copies").join(found, "text_no", "left").drop("text_no"), "repeated")


def spans(n: int, copies: int, ranges: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Disjoint, ascending byte ranges to remove."""
    if copies > 1 and n >= length:
        return [(0, n)]
    out: list[tuple[int, int]] = []
    for x in ranges or ():
        low, high = x["first"], x["last"] + length
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def whole_characters(data: bytes, span: tuple[int, int]) -> tuple[int, int]:
    """The span with the rest of UTF-8 characters that it cuts."""
    low, high = span
    while low > 0 and data[low] & 0xC0 == 0x80:
        low -= 1
    while high < len(data) and data[high] & 0xC0 == 0x80:
        high += 1
    return low, high


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK, characters: bool = False) -> DataFrame:
    """``docs`` with ``kept`` (the remaining bytes), ``n_bytes``, ``n_removed`` and ``n_spans``.

    With ``characters`` a character that is removed in part goes as a whole, so ``kept`` is UTF-8 again.
    """
    found = repeated_starts(docs, length, gram, chunk)
    results = list(RESULTS)
    rows = docs.drop(*results)
    # Digests are joined per row number of ids and digests, narrow rows, so that copies spread over tasks.
    which = docs.select(F.col("doc_id").alias("__id"), _digest().alias("__digest")).distinct()
    verdicts = which.join(found.withColumnRenamed("digest", "__digest"), "__digest").select("__id", "__digest", "copies", "ranges")
    verdicts = verdicts.select("__id", "__digest", F.col("copies").alias("__copies"), F.col("ranges").alias("__ranges"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__digest"))
    joined = rows.withColumn("__own", _digest()).join(verdicts, same, "left").drop("__own", "__digest", "__id")
    names = rows.columns
    at, width = names.index("text"), len(names)
    schema = rows.withColumns({"kept": F.lit(b""), "n_bytes": F.lit(0).cast("bigint"), "n_removed": F.lit(0).cast("bigint"), "n_spans": F.lit(0).cast("bigint")}).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, removed, number = [], [], [], []
            for text, copies, ranges in zip(*(batch.column(i).to_pylist() for i in (at, width, width + 1)), strict=True):
                data = (text or "").encode()
                gone = spans(len(data), copies, ranges, length)
                if characters:
                    gone = [whole_characters(data, x) for x in gone]
                borders = [0, *(x for span in gone for x in span), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(borders[0::2], borders[1::2], strict=True)))
                sizes.append(len(data))
                removed.append(len(data) - len(kept[-1]))
                number.append(len(gone))
            made = [pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, number))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=[*names, *results])

    return joined.mapInArrow(cut, schema)
