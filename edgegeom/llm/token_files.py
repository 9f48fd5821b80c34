"""Token-id files: concatenated ids with Elias-Fano encoded document boundaries.

A shard file holds ``MAGIC``, a JSON line of sizes, the boundaries, the document ids and the ids as 2- or
4-byte integers. Boundaries and document ids are ascending, so both are Elias-Fano sequences: low bits
packed, high bits in unary, and the place of every 64th one sampled in 32 bits, from which a select
finds the n-th offset without a table of 64-bit offsets. Documents are dealt by ranges of doc_id and
sorted within, so the shards, in order of range and number, hold all documents in ascending doc_id.

Defined results: a null text is empty and has the end id alone; null doc_ids come first; rows of one
doc_id follow each other in the order of their texts' hashes, repeated rows are repeated documents; very long
texts are encoded whole in their task; ids may be any longs, and a shard ends where they lie too far
apart; other columns are not read; an empty table gives no shard and no row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage, staging_path
from .common import text_of
from .files import Output, locate, new_name
from .units import encoder_of, small_batches

MAGIC = b"EFTOKENS1\n"
#: A shard is closed when it has so many ids.
SHARD_IDS = 8 << 20
#: A shard's document ids lie closer than this, so that their differences are longs.
WIDEST = 1 << 62
#: Values whose low bits are packed at a time; a multiple of 8.
SLICE = 1 << 16
#: Every so many ones of the high bits have their place sampled.
EVERY = 64
#: Documents read from a shard at a time.
BATCH = 256
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.int64)


class EliasFano:
    """An ascending sequence of non-negative integers in about ``2 + log2(u / n)`` bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.int64)
        slices = (values[at : at + SLICE, None] for at in range(0, n, SLICE))
        packed = [np.packbits(((x >> shifts) & 1).astype(np.uint8).ravel(), bitorder="little") for x in slices]
        low = np.concatenate([*packed, np.zeros(0, np.uint8)])
        ones = (values >> low_bits) + np.arange(n, dtype=np.int64)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::EVERY].astype("<u4"))

    def parts(self) -> tuple[list[int], bytes]:
        data = [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]
        return [self.n, self.low_bits, *map(len, data)], b"".join(data)

    @classmethod
    def decode(cls, sizes: list[int], data: bytes) -> EliasFano:
        n, low_bits, a, b, c = sizes
        return cls(n, low_bits, np.frombuffer(data, np.uint8, a), np.frombuffer(data, np.uint8, b, a), np.frombuffer(data, "<u4", c // 4, a + b))

    def _select(self, i: int) -> int:
        """Place of the i-th one of the high bits."""
        at = int(self.samples[i // EVERY])
        left, byte = i % EVERY, at // 8
        window = self.high[byte : byte + 8 * EVERY].copy()
        window[0] &= (0xFF << (at % 8)) & 0xFF
        seen = np.cumsum(_ONES[window])
        while left >= seen[-1]:  # a long run of zeros
            left -= int(seen[-1])
            byte += len(window)
            window = self.high[byte : byte + 8 * EVERY]
            seen = np.cumsum(_ONES[window])
        k = int(np.searchsorted(seen, left, side="right"))
        left -= int(seen[k - 1]) if k else 0
        bits = np.flatnonzero(np.unpackbits(window[k : k + 1], bitorder="little"))
        return 8 * (byte + k) + int(bits[left])

    def __getitem__(self, i: int) -> int:
        high = self._select(i) - i
        if not self.low_bits:
            return high
        start = i * self.low_bits
        raw = int.from_bytes(self.low[start // 8 : (start + self.low_bits + 7) // 8].tobytes(), "little")
        return (high << self.low_bits) | (raw >> (start % 8)) & ((1 << self.low_bits) - 1)


def _write_shard(folder: str, kind: np.dtype, ids: list[bytes], doc_ids: list[int | None]) -> dict:
    lengths = np.array([len(x) // kind.itemsize for x in ids], dtype=np.int64)
    ends = EliasFano.encode(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))
    known = [x for x in doc_ids if x is not None]
    least = known[0] if known else 0
    names = EliasFano.encode(np.array([x - least for x in known], dtype=np.int64))
    (end_sizes, end_data), (name_sizes, name_data) = ends.parts(), names.parts()
    head = {"width": kind.itemsize, "documents": len(ids), "nulls": len(doc_ids) - len(known), "least": least, "ends": end_sizes, "names": name_sizes}
    out = Output(new_name(folder, ".tokens"))
    out.write(MAGIC + json.dumps(head).encode() + b"\n" + end_data + name_data)
    for x in ids:
        out.write(x)
    out.close()
    return {"file": out.uri, "documents": len(ids), "ids": int(lengths.sum())}


class Shard:
    """A shard opened for reading: boundaries in memory, ids read as they are asked for."""

    def __init__(self, uri: str):
        system, path = locate(uri)
        self.file = system.open_input_file(path)
        head = self.file.read(1 << 12)
        line, _, _ = head[len(MAGIC):].partition(b"\n")
        if not head.startswith(MAGIC):
            raise ValueError(f"{uri} is no token file")
        self.head = json.loads(line)
        at = len(MAGIC) + len(line) + 1
        sizes = [sum(self.head[k][2:]) for k in ("ends", "names")]
        data = self.file.read_at(sum(sizes), at)
        self.ends = EliasFano.decode(self.head["ends"], data[: sizes[0]])
        self.names = EliasFano.decode(self.head["names"], data[sizes[0]:])
        self.at, self.kind = at + sum(sizes), np.dtype(f"<u{self.head['width']}")

    def doc_id(self, i: int) -> int | None:
        return None if i < self.head["nulls"] else self.head["least"] + self.names[i - self.head["nulls"]]

    def ids(self, start: int, stop: int) -> np.ndarray:
        width = self.kind.itemsize
        return np.frombuffer(self.file.read_at((stop - start) * width, self.at + start * width), dtype=self.kind)


def write(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Encodes and writes all documents; the staged manifest ``file, part, number, documents, ids``."""
    folder = folder or staging_path(docs.sparkSession, "tokens")
    # Rows of one id, null included, are dealt by their texts and copies, so no id is a partition of its own.
    keys = ["doc_id", "hash", "copy"]
    rows = docs.select("doc_id", text_of().alias("text"), F.xxhash64(text_of()).alias("hash"), F.monotonically_increasing_id().alias("copy"))
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        part, held, names, size, least, made = TaskContext.get().partitionId(), [], [], 0, None, []

        def close() -> None:
            nonlocal held, names, size, least
            made.append(_write_shard(folder, encoder.kind, held, names) | {"part": part, "number": len(made)})
            held, names, size, least = [], [], 0, None

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, some in small_batches(texts):
                for i, x in enumerate(encoder(some)):
                    name = ids[at + i]
                    if name is not None and least is not None and name - least >= WIDEST:
                        close()
                    least = name if least is None else least
                    held.append(x + end)
                    names.append(name)
                    size += len(held[-1]) // encoder.width
                    if size >= SHARD_IDS:
                        close()
        if held:
            close()
        yield pa.RecordBatch.from_pylist(made, pa.schema([("file", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64())]))

    return stage(rows.mapInArrow(put, "file string, part int, number int, documents bigint, ids bigint"), "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, ids as little-endian unsigned 32-bit integers."""
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard, not per document
    placed = manifest.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    placed = placed.repartition(max(1, manifest.count()))

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                shard = Shard(x["file"])
                for at in range(0, shard.head["documents"], BATCH):
                    stop = min(shard.head["documents"], at + BATCH)
                    ends = [shard.ends[i] for i in range(at, stop + 1)]
                    ids = shard.ids(ends[0], ends[-1]).astype("<u4")
                    cut = [ids[a - ends[0] : b - ends[0]].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([shard.doc_id(i) for i in range(at, stop)], pa.int64()), pa.array([x["base"] + e for e in ends[:-1]], pa.int64()),
                        pa.array([b - a for a, b in zip(ends, ends[1:], strict=False)], pa.int64()), pa.array(cut, pa.binary()),
                    ], ["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(get, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
