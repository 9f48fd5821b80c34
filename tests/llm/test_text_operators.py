"""Chat formatting, fingerprints, language ID and quality rules."""

import collections
import hashlib
import json
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from edgegeom.llm import catalog, chat, fingerprints, language, quality, queries_text
from tests.llm.conftest import prose


def said(*texts):
    return [(None, "user"), *texts]


@pytest.fixture(scope="module")
def turns(spark):
    rows = [
        (1, 1, "assistant", "b </s>[INST] \\ \\\\ <|im_end|>\n"), (1, 0, "user", "a"), (2, 0, None, None), (2, None, "user", "first"),
        (2, 0, "assistant", ""), (3, 5, "assistant", "😀<"), (3, 5, "assistant", "😀<"), (None, 0, "user", "no id"), (4, 0, "ro\nle", "<|im_sep|>"),
    ]
    return spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")


def test_turns_come_back_whole(spark, turns):
    out = chat.format_turns(chat.canonical_turns(turns))
    back = out.select("conv_id", "turns", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    rows = back.collect()
    assert len(rows) == 5
    for r in rows:
        assert [(t.role, t.text) for t in r.back] == [(t.role, t.text) for t in r.turns]
        assert r.loss == "".join(t.text for t in r.turns if t.role == "assistant")


def test_empty_conversations(spark, turns):
    assert chat.format_turns(chat.canonical_turns(turns.limit(0))).count() == 0
    none = spark.range(1).select(F.lit(1).alias("conv_id"), F.array().cast("array<struct<role:string,content:string>>").alias("messages"))
    assert chat.format_turns(chat.canonical_turns(none)).select("formatted", chat.read_turns(F.col("formatted")).alias("b")).first() == ("", [])


def test_layouts_by_fingerprint(spark):
    want = [("user", "q"), ("assistant", "a")]
    shapes = {
        "prompt string, completion string": ("q", "a"), "instruction string, output string": ("q", "a"),
        "messages array<struct<role:string,content:string>>": ([("user", "q"), ("assistant", "a")],),
        "conversations array<struct<from:string,value:string>>": ([("human", "q"), ("gpt", "a")],),
        "question string, answer string, extra string": ("q", "a", "more"),
    }
    for schema, row in shapes.items():
        df = spark.createDataFrame([(9, *row)], f"conv_id bigint, {schema}")
        assert [(t.role, t.text) for t in chat.canonical_turns(df).first().turns] == want
    with pytest.raises(ValueError, match="no layout"):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id bigint, other string"))


def test_records_of_mixed_layouts(spark):
    records = [
        json.dumps({"prompt": "q", "completion": "a"}), json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}),
        json.dumps({"instruction": "q", "output": "a"}), "{}", "not json", None,
    ]
    df = spark.createDataFrame(list(enumerate(records)), "id bigint, record string")
    rows = {r.id: r for r in chat.record_turns(df, "id", "record").collect()}
    assert [rows[i].layout for i in range(6)] == ["prompt and completion", "messages", "instruction", None, None, None]
    assert all([(t.role, t.text) for t in rows[i].turns] == [("user", "q"), ("assistant", "a")] for i in range(3))
    assert all(rows[i].turns == [] for i in range(3, 6))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_queries_equal_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("benchmark", "conversations", "documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found = con.sql(catalog.SQL[name])
    order = sorted(found.columns)
    want = sorted((tuple(r) for r in con.sql(f"SELECT {', '.join(order)} FROM ({catalog.SQL[name]})").fetchall()), key=repr)
    assert sorted((tuple(r) for r in catalog.QUERIES[name](spark, folder).select(order).collect()), key=repr) == want


def weighted_jaccard(a, b):
    a, b = collections.Counter(a.lower().split()), collections.Counter(b.lower().split())
    both = sum((a | b).values())
    return sum((a & b).values()) / both if both else 1.0


def test_edited_texts_and_likeness(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(0, 300))) for i in range(80)] + [(80, None), (81, "")]
    got = {r.doc_id: r for r in fingerprints.edited_likeness(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    errors = []
    for at, (i, text) in enumerate(order):
        following = order[(at + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [got[i].near_edited - weighted_jaccard(text, edited), got[i].near_next - weighted_jaccard(text, following)]
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.3
    assert got[80].fingerprint == got[81].fingerprint


def test_fingerprints_of_extreme_ids(spark):
    rows = [(i, f"text of {i} and of others") for i in (-(2**63), -1, 0, 2**63 - 1)]
    got = {r.doc_id: r for r in fingerprints.edited_likeness(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    order = sorted(rows, reverse=True)
    for at, (i, text) in enumerate(order):
        following, half = order[(at + 1) % len(order)][1], len(text) // 2
        assert got[i].edited_sha256 == hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()


def test_fingerprints_of_many_blocks(spark, docs, monkeypatch):
    whole = fingerprints.edited_likeness(docs).orderBy("doc_id", "edited_sha256").collect()
    monkeypatch.setattr(fingerprints, "BLOCK_BYTES", 3000)
    assert fingerprints.edited_likeness(docs).orderBy("doc_id", "edited_sha256").collect() == whole
    assert len(whole) == docs.count()


def test_fingerprints_of_few_rows(spark, no_docs):
    assert fingerprints.edited_likeness(no_docs).count() == 0
    one = fingerprints.edited_likeness(spark.createDataFrame([(5, "alone here")], "doc_id bigint, text string")).first()
    assert (one.n_chars, one.near_next) == (10, 1.0)


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def brute_distance(p, q):
    mean = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda a: sum(x * math.log2(x / m) for x, m in zip(a, mean, strict=True) if x > 0)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def brute_classes(text):
    found = collections.Counter()
    for c in text:
        kind = "capital" if re.match(r"[A-ZÄÖÜÑÉÈ]", c) else "letter" if c.isalpha() else "digit" if c in "0123456789" else "space" if c in quality.SPACES else "symbol" if c in quality.SYMBOLS else "punctuation" if c in quality.PUNCTUATION else "other"
        found[kind] += 1
    return [found[k] / len(text) for k in quality.CLASSES]


def test_quality_counts_and_verdict(spark, docs):
    known = quality.references(docs)
    rows = quality.judge(docs, known).collect()
    assert len(rows) == docs.count() and set(docs.columns) <= set(rows[0].asDict())
    for r in rows:
        n, *rest = brute_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 50 or 100 * rest[-1] > 50 * n)
        words = collections.Counter(w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        shares = [words[w] / max(1, n) for w in quality.COMMON]
        rare = [0.0] * len(shares) + [1.0]
        apart = [(brute_distance([*shares, 1 - sum(shares)], q), brute_distance(rare, q)) for _, q in known]
        want = min(d / far if far >= quality.LEAST_WORD_DISTANCE else 0 for d, far in apart) if n >= quality.MIN_WORDS_COMMON else 0
        assert r.word_distance == pytest.approx(want, abs=1e-6)
        far = min(brute_distance(brute_classes(r.text), q) for q, _ in known) if len(r.text or "") >= quality.MIN_CHARS_CLASSES else 0
        assert r.class_distance == pytest.approx(far, abs=1e-6)
        assert r.kept == (not r.base_failed and r.class_distance <= quality.MAX_CLASS_DISTANCE and r.word_distance <= quality.MAX_WORD_SHARE)


def test_prose_without_common_words_fails(spark):
    rng = random.Random(17)
    made = lambda n, common: " ".join(
        rng.choice(quality.COMMON[:20]) if rng.random() < common else "".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(3, 9))) for _ in range(n))
    rows = [(i, made(400, 0.3), "en") for i in range(60)] + [(100 + i, made(400, 0.0), "en") for i in range(6)] + [(200 + i, made(400, 0.2), None) for i in range(6)]
    judged = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(not r.base_failed and r.class_distance <= quality.MAX_CLASS_DISTANCE for r in judged.values())
    assert all(r.kept == (i < 100 or i >= 200) for i, r in judged.items())


def test_quality_counts_beyond_the_packed_positions(docs, monkeypatch):
    monkeypatch.setattr(quality, "POSITIONS", 16)
    for r in quality.judge(docs).select("text", "n_repeat_words").collect():
        assert r.n_repeat_words == brute_counts(r.text)[-1]


def test_quality_of_an_empty_table(no_docs):
    assert quality.references(no_docs) == [] and quality.judge(no_docs).count() == 0


def plain_grams(text):
    """Hashed 1- to 3-grams of the bytes of a text's letters, one by one."""
    raw = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in (text or "").lower().encode())
    raw = b" " + " ".join(raw.decode("latin-1").split()).encode("latin-1") + b" "
    found = collections.Counter()
    for n in (1, 2, 3):
        for i in range(len(raw) - n + 1):
            code = int.from_bytes(raw[i : i + n], "big") + (0, 1 << 25, 1 << 26)[n - 1]
            found[(code * 2654435761 % 2**32) >> 20] += 1
    return found


def test_language_equals_a_plain_search(spark, docs):
    """Document frequencies, the nearest centroid, its cosine and the rejection, dimension by dimension."""
    model = language.fit(docs)
    rows = docs.collect()
    train = [plain_grams(r.text) for r in rows if r.text is not None and r.lang is not None]
    for at in range(0, language.DIMENSIONS, 7):
        df = sum(at in g for g in train)
        want = math.log((1 + len(train)) / (1 + df)) + 1e-3 if df else math.log(1 + len(train))
        assert math.isclose(model.idf[at], want, rel_tol=1e-9)
    assert all(model.languages.count(x) <= language.CLUSTERS for x in model.languages)
    found = {(r.doc_id, r.text): r for r in language.predict(docs, model).collect()}
    for r in rows:
        got = found[r.doc_id, r.text]
        if not any(c.isalpha() for c in r.text or ""):
            assert (got.lang_pred, got.score, got.rejected) == (language.UNKNOWN, 0, True)
            continue
        v = {at: math.sqrt(n) * model.idf[at] for at, n in plain_grams(r.text).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * float(c[at]) for at, x in v.items()) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert got.score == pytest.approx(min(1, max(0, cosines[best])), abs=1e-5)
        if sorted(cosines)[-1] - max([c for c, x in zip(cosines, model.languages, strict=True) if x != model.languages[best]], default=-1) > 1e-5:
            assert got.lang_pred == model.languages[best]
        if abs(1 - cosines[best] - model.radii[best]) > 1e-5:
            assert got.rejected == (1 - cosines[best] > model.radii[best])


def test_language_on_held_out_rows(spark):
    docs = queries_text.table(spark, "/root/testdata/sf0.01", "documents")
    got = queries_text.op8_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out and n_chars > 100").collect()
    right = sum(r.lang == r.lang_pred for r in got)
    assert len(got) > 200 and right / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) / len(got) < 0.02


def test_language_of_awkward_texts(spark, docs, no_docs):
    model = language.fit(docs)
    rows = language.predict(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letter) and (letter or (r.rejected and r.score == 0))
    assert language.predict(no_docs, model).count() == 0
    none = language.predict(docs.where("text = 'one'"), language.fit(no_docs)).first()
    assert (none.lang_pred, none.score, none.rejected) == ("und", 0.0, False)
    far = spark.createDataFrame([("漢字" * 100,)], "text string")
    assert language.predict(far, language.fit(docs.where("length(text) < 3000 and doc_id > 20"))).first().rejected


def test_language_of_copies_is_learned(spark):
    texts = spark.range(5).select(F.concat(F.lit("palabra número "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"))
    copies = spark.range(20_000).join(texts).select("text", F.lit("es").alias("lang"))
    other = spark.createDataFrame([(f"the word {'qrst'[i]} of it", "en") for i in range(4)], "text string, lang string")
    few = language.fit(texts.withColumn("lang", F.lit("es")).union(other))
    many = language.fit(copies.union(other))
    assert many.languages == few.languages and set(many.languages) == {"en", "es"}
    assert sum(x == "es" for x in many.languages) == 4
    assert {r.lang_pred for r in language.predict(texts, many).collect()} == {"es"}
