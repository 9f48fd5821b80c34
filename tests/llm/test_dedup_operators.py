"""N-gram Jaccard join, suffix order and the pipeline, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from edgegeom.llm import jaccard, suffix_dedup
from edgegeom.llm.components import connected
from edgegeom.llm.suffix_order import suffix_order
from edgegeom.staging import stage
from tests.llm.conftest import prose


def shingle_set(text, width=5):
    words = (text or "").lower().split()
    n = min(width, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute_join(rows, threshold):
    sets = [shingle_set(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= threshold * len(a | sets[j]):
                links[i], links[j] = links[i] + 1, links[j] + 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i, (x, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(x)
    return sorted(((x, min((y for y in groups[top(i)] if y is not None), default=None), links[i]) for i, (x, _) in enumerate(rows)), key=repr)


def near_copies(rng, n):
    out = []
    for base in (prose(rng, 150), prose(rng, 60)):
        for _ in range(n):
            words = base.split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"w{rng.randrange(1000)}"
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("chunk", [1000, 7])
def test_join_equals_brute_force(spark, docs, chunk):
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += [(1000 + i, t) for i, t in enumerate(near_copies(rng, 40))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = jaccard.jaccard_join(df, chunk=chunk)
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got.collect()), key=repr) == brute_join(rows, 0.8)


def test_one_of_each_class_stays(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) <= set(rows)
    left = brute_join(got, 0.8)
    assert all(n == 0 for _, _, n in left)
    assert {i for i, _, n in brute_join(rows, 0.8) if n == 0} <= {i for i, _ in got}
    assert jaccard.keep_one(no_docs).count() == 0 and jaccard.jaccard_join(no_docs).count() == 0


def test_classes_of_one_least_id_stay_apart(spark):
    rng = random.Random(13)
    rows = []
    for ids in [(None, None), (None, None), (7, 50), (7, 51), (8, 8), (8, 8)]:
        text = prose(rng, 150)
        rows += [(ids[0], text), (ids[1], f"{text} omega")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [r.text.removesuffix(" omega") for r in jaccard.keep_one(df).collect()]
    assert sorted(kept) == sorted(t for _, t in rows[::2])


def test_bands_reach_the_wanted_recall():
    bands, rows = jaccard.choose_bands(0.8, 0.9999, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "u bigint, v bigint"), "test").collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, 101: 100, 102: 100}


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(3000):
        s = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 40))]
        assert suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("chunk", [2, 5, 256])
def test_buckets_verify_what_whole_parts_do(spark, docs, monkeypatch, chunk):
    """Every part goes bucket by bucket, then every part as a whole."""
    df = docs.select("doc_id", "text")
    told = lambda: sorted(((r.doc_id, r.text_hash, r.class_id, r.n_copies, r.n_links) for r in jaccard.jaccard_join(df, 0.5, 2, chunk).collect()), key=repr)
    usual, split = told(), jaccard.groups
    monkeypatch.setattr(jaccard, "groups", lambda parts, buckets, chunk: split(parts, buckets.withColumn("n", F.lit(0).cast("bigint")), 0).select(
        "node", F.transform("groups", lambda x: F.struct(x["band"].alias("band"), x["part"].alias("part"), F.lit(40).cast("bigint").alias("size"))).alias("groups")))
    assert told() == usual


def test_a_chain_of_dissimilar_texts_stays_linear(spark, monkeypatch):
    """Each text shares half of its words with the next one; one-row bands link them all to one part."""
    monkeypatch.setattr(jaccard, "choose_bands", lambda threshold: (24, 1))
    n, seen, split = 1500, [], jaccard.groups
    rng = random.Random(6)
    word = [f"w{i}x{rng.random()}" for i in range(20 * n + 40)]
    rows = [(i, " ".join(word[20 * i : 20 * i + 40])) for i in range(n)]

    def counted(parts, buckets, chunk):
        found = stage(split(parts, buckets, chunk), "groups")
        largest = parts.groupBy("part").count().agg(F.max("count")).first()[0]
        pairs = found.select(F.inline("groups")).agg(F.sum("size")).first()[0]
        seen.append((largest, pairs))
        return found

    monkeypatch.setattr(jaccard, "groups", counted)
    out = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string"), 0.8, 1, 64).collect()
    assert all(r.n_links == 0 and r.class_id == r.doc_id for r in out) and len(out) == n
    assert seen[0][0] > 1000 and seen[0][1] < 100 * n


def brute_repeats(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in data:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for (x, _), t in zip(rows, data, strict=True):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((x, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "gram", "chunk"), [(400, 128, 1000), (40, 13, 1000), (40, 13, 4), (20, 20, 1000)])
def test_repeats_equal_brute_force(spark, docs, length, gram, chunk):
    rng = random.Random(9)
    base = "".join(rng.choice("abcé ") for _ in range(600))
    rows = [(r.doc_id, r.text) for r in docs.where("length(text) < 6000 or text is null").select("doc_id", "text").collect()]
    for i in range(25):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 4])):
            text[rng.randrange(len(text))] = rng.choice(["x", "", "yy"])
        a = rng.randrange(200)
        rows.append((2000 + i, "".join(text[a : a + rng.randrange(500)]) + rng.choice(["", "z" * rng.randrange(80), "pq" * 30, base[:50]])))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), length, gram, chunk)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()), key=repr) == brute_repeats(rows, length)


def test_hot_anchors_stay_linear(spark):
    run = "z" * 3000
    df = spark.createDataFrame([(1, run + "end"), (2, "start" + run)], "doc_id bigint, text string")
    texts = suffix_dedup._texts(df, 40, 13)
    rows, twice = suffix_dedup._contexts(df, texts, 40, 64)
    assert rows.agg(F.sum(F.size("places"))).first()[0] < 500 and twice is not None
    found = suffix_dedup.repeated_starts(df, 40, 13, 64).collect()
    assert all(len(r.ranges) <= 2 for r in found)
    got = suffix_dedup.remove_repeats(df, 40, 13, 64).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_repeats([(r.doc_id, r.text) for r in got], 40)


def test_cut_characters_go_whole():
    assert suffix_dedup.whole_characters("aéb".encode(), (2, 3)) == (1, 3)
    assert suffix_dedup.whole_characters("aéb".encode(), (0, 2)) == (0, 3)


def test_pipeline_stages_against_brute_force(spark, tables):
    folder = f"{tables}/some"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, function in corpus_pipeline.STAGES:
        before = docs.collect()
        new = stage(function(spark, docs, folder), "test-stage")
        if name == "packing":
            break
        assert new.columns == docs.columns
        after = new.collect()
        if name == "suffix-array dedup":
            want = {x: k.decode("utf-8", "ignore") for x, _, _, _, k in brute_repeats([(r.doc_id, r.text) for r in before], corpus_pipeline.REPEATED_BYTES)}
            assert {r.doc_id: r.text or "" for r in after} == want
            assert all(r.n_chars == len(r.text) for r in after)
        else:
            assert {tuple(r) for r in after} <= {tuple(r) for r in before}
        if name == "n-gram Jaccard join":
            assert len({r.doc_id for r in after}) == len({c for _, c, _ in brute_join([(r.doc_id, r.text) for r in before], 0.8)})
        docs = new
    pieces = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, pieces.collect())) == sorted(map(tuple, new.collect()))
    got = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.collect()) and all(r.n == r.m for r in got)


def test_pipeline_cuts_passages_of_over_fifty_words(spark, tables):
    rng = random.Random(12)
    passage = " ".join(rng.choice("able baker cargo delta eagle fable gamma hotel".split()) + str(i) for i in range(51))
    rows = [(i, f"{prose(rng, 60)} {passage} {prose(rng, 60)}") for i in range(3)] + [(9, prose(rng, 200))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert 250 < len(passage) < 400
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_strings(spark, df, "").collect()}
    assert all(passage not in got[i] and len(got[i]) > 500 for i in range(3)) and got[9] == rows[3][1]


def test_pipeline_on_an_empty_table(spark, tables):
    assert corpus_pipeline.run(spark, f"{tables}/none").count() == 0
