"""Packing, byte-level BPE, token files and archives: round trips and the libraries' own results."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from edgegeom.llm import bpe, packing, token_files, units, warc
from tests.llm.conftest import prose

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def library(path, texts):
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return [x.ids for x in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


ODD = ["x.y. é. ﬁ. İ. don't. 'S. \ufb2a. ö: e\u0301. 漢.", "a\x1cb \x1d c", "a  b\n\n c \t d", "don't we'll 'S", "\xa0x y\x85z", "é É ﬁ İ", "<|endoftext|> <|startoftext|>", " lead", "trail ", "1234 5,6"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_units_encode_as_the_library(path, docs):
    texts = [r.text for r in docs.collect()] + ODD
    made = units.Encoder(path)(texts)
    assert [np.frombuffer(x, made and units.Encoder(path).kind).tolist() for x in made] == library(path, texts)


def test_packing_holds_every_id_once(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    pieces = packing.pack(packing.token_pieces(docs, WORD, 1, 64), 64)
    got = pieces.collect()
    want = sorted((i, np.array([*ids, 1], "<u4").tobytes()) for (i, _), ids in zip(rows, library(WORD, [t for _, t in rows]), strict=True) if i is not None and i > 5)
    whole = {}
    for r in sorted(got, key=lambda r: (repr(r.doc_id), r.start)):
        if r.doc_id is not None and r.doc_id > 5:
            assert r.start == len(whole.get(r.doc_id, b"")) // 4 and r.length == len(r.ids) // 4
            whole[r.doc_id] = whole.get(r.doc_id, b"") + bytes(r.ids)
    assert sorted(whole.items()) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(by) == list(range(len(by)))
    padded = packing.sequences(pieces, 64).collect()
    assert all(len(r.ids) == 4 * 64 or bin(len(r.ids) // 4).count("1") == 1 for r in padded) and len(padded) == len(by)
    assert packing.pack(packing.token_pieces(no_docs, WORD, 1)).count() == 0


def test_patterns_use_up_the_histogram():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([8, 64, 2048])
        histogram = {rng.randint(1, capacity): rng.randint(1, 1000) for _ in range(rng.randint(0, 60))}
        patterns = packing.pack_histogram(histogram, capacity)
        used = {}
        for pattern, n in patterns:
            assert sum(pattern) <= capacity
            for length in pattern:
                used[length] = used.get(length, 0) + n
        assert used == histogram
        placed = {}
        for length, first, after, *_ in packing.slots(patterns):
            assert first == placed.get(length, 0)
            placed[length] = after
        assert placed == histogram


@pytest.mark.parametrize(("chunk", "overlap"), [(bpe.CHUNK, bpe.OVERLAP), (300, 40), (50, 8)])
def test_bpe_encodes_and_decodes(spark, docs, no_docs, chunk, overlap):
    coder = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    more = spark.createDataFrame([(3000 + i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string")
    texts = docs.select("doc_id", "text").union(more)
    got = bpe.decode(bpe.encode(texts, RANKS, public_tokenizers.PATTERN, chunk, overlap), RANKS).collect()
    want = [(r.doc_id, np.array(coder.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in texts.collect()]
    assert sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got), key=repr) == sorted(want, key=repr)
    assert bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN, chunk, overlap).count() == 0


def test_elias_fano():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.choice([0, 1, 2, 63, 64, 65, 500])
        values = np.sort(np.array([rng.randrange(rng.choice([1, 10, 10**6, 10**12])) for _ in range(n)], dtype=np.int64))
        made = token_files.EliasFano.encode(values)
        back = token_files.EliasFano.decode(*made.parts())
        assert [back[i] for i in range(n)] == values.tolist()
    big = np.sort(np.random.RandomState(1).randint(0, 10**7, 10_000))
    assert len(token_files.EliasFano.encode(big).parts()[1]) * 8 < 10_000 * (2 + 11 + 1)


def check_token_files(got, rows):
    """Documents in ascending doc_id, those of one id in any order, gapless."""
    want, at = {}, 0
    for (i, _), ids in zip(rows, library(BYTE, [t for _, t in rows]), strict=True):
        want.setdefault(i, []).append(np.array([*ids, 0], "<u4").tobytes())
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    for r in got:
        want[r.doc_id].remove(bytes(r.ids))
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens


def test_token_files_come_back(spark, docs, no_docs, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 500)
    got = token_files.read(token_files.write(docs, BYTE)).orderBy("start").collect()
    check_token_files(got, [(r.doc_id, r.text or "") for r in docs.collect()])
    assert token_files.read(token_files.write(no_docs, BYTE)).count() == 0


def test_token_files_bear_any_ids(spark, monkeypatch):
    """The least and largest longs in one range, and a third of all rows under one id and under none."""
    rng = random.Random(13)
    rows = [(i, prose(rng, 3)) for i in (-(2**63), -(2**62), -1, 0, 1, 2**62, 2**63 - 1)]
    rows += [(5, prose(rng, rng.randint(0, 9))) for _ in range(60)] + [(None, prose(rng, 2)) for _ in range(60)] + [(7, "copy")] * 60
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for partitions in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            manifest = token_files.write(docs, BYTE)
            check_token_files(token_files.read(manifest).orderBy("start").collect(), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.agg(F.max("documents")).first()[0] < len(rows) // 3  # neither id is one task's


@pytest.mark.parametrize("least", [0, 5])
def test_archives_come_back(spark, least, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    html = ["<p>é\r\n\r\n</p>", "same", "same", "", None, "x" * 20_000, "same", "long one", "long one"]
    rows = [(i, f"http://x/{i}\r\n {i}", t, "clash") for i, t in enumerate(html)] + [(1, "http://x/1", "same", "repeated"), (None, None, "long one", None), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string").repartition(3)
    index = warc.write(pages, min_revisit=least)
    got = warc.read(index, gap=10, size=500).collect()
    first = {}
    for i, _, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    want = []
    for i, _, t, _ in rows:
        data = (t or "").encode()
        to = first.get(t or "") if len(data) >= least else None
        to = None if to == i else to
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to, data if to is None else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload if r.payload is None else bytes(r.payload)) for r in got), key=repr) == sorted(want, key=repr)
    some = index.where("page_id in (0, 5)")
    assert {r.page_id for r in warc.read(some).collect()} == {0, 5}
    whole = warc.ranges(index).agg(F.count(F.lit(1)), F.countDistinct("file")).first()
    assert whole[0] == whole[1]
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_archives_are_read_by_many_tasks(spark):
    pages = spark.createDataFrame([(i, "u", "copy" if i % 3 == 0 else random.Random(i).randbytes(300).hex()) for i in range(300)], "page_id bigint, url string, html string")
    index = warc.write(pages)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        read = warc.read(index, size=10_000).withColumn("task", F.spark_partition_id())
        assert read.select("task").distinct().count() > 3 and read.count() == 300
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_records_are_checked():
    raw = warc.record(1, "u", b"abc", base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), None)
    assert warc.parse(raw)["payload"] == b"abc"
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(raw.replace(b"abc", b"abd"))
    assert zlib.decompress(zlib.compress(raw)) == raw


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_new_words_are_encoded_many_in_a_call(path):
    """No call for each word, and words that hold more than one pre-token, or none, stay right."""
    words = ["".join(chr(97 + (i * k) % 26) for k in range(2, 9)) for i in range(1, 2000)]
    texts = [" ".join(words[at : at + 100]) for at in range(0, len(words), 100)] + [" ".join(map(str.title, words[:50])), "a" * 3000, "don't ab1cd x-y ​ z", "", None]
    own, calls = units.Encoder(path), []

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, rows, **how):
            calls.append(len(rows))
            return self.tokenizer.encode_batch_fast(rows, **how)

    own.tokenizer, own.plain = Counted(own.tokenizer), own.plain and Counted(own.plain)
    made = own(texts)
    assert [np.frombuffer(x, own.kind).tolist() for x in made] == library(path, texts)
    assert sum(calls) < 100


def test_batches_end_by_texts_and_characters():
    texts = ["ab", None, "c" * 9, "", "d", "e"]
    assert [*units.small_batches(texts, 2, 5)] == [(0, ["ab", None]), (2, ["c" * 9]), (3, ["", "d"]), (5, ["e"])]
    assert [*units.small_batches([])] == [] and [*units.small_batches(texts)] == [(0, texts)]
