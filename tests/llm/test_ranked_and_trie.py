"""Ranked lexical search, quality classifier and conversation prefix trie against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from edgegeom.llm import factorisation, lexical, prefix_trie, queries_ranked, queries_trie
from tests.llm.conftest import prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    bags = [(i, collections.Counter(plain_terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            m = 25 + 75 * sum(b.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in plain_terms(text) if b[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(11)
    texts = [None, "", "...", "the the The of", prose(rng, 30), "ALPHA beta-beta ÄÖÜ ß 漢字", "nowhere", "a b", "x" * 5000, prose(rng, 2000), "text without an id"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(4, "kappa of", "clash", 1), (None, "lambda iota", None, None)]
    return spark.createDataFrame(rows, "item_id bigint, text string, doc_id string, n int")


@pytest.mark.parametrize("path", ["small vocabulary", "joined vocabulary", "many blocks"])
def test_search_equals_all_pairs(spark, docs, items, monkeypatch, path):
    if path == "joined vocabulary":
        monkeypatch.setattr(lexical, "VOCABULARY", 3)
    if path == "many blocks":
        monkeypatch.setattr(lexical, "POSTINGS", 40)
        monkeypatch.setattr(lexical, "CELLS", 8)
    found = lexical.search(docs, items, 4).collect()
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 4)
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in found), key=repr) == sorted(want, key=repr)


def test_search_expands_copies_by_id(spark):
    rows = [(i, "common words here" if i % 3 else f"word{i}") for i in range(3000, 0, -1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = lexical.search(docs, spark.createDataFrame([(7, "words word9")], "item_id bigint, text string")).orderBy("rank").collect()
    assert [r.doc_id for r in found] == [9, 1, 2, 4, 5, 7, 8, 10, 11, 13] and found[1].n_same == 2000


def test_search_of_empty_tables(spark, docs, no_docs, items):
    for given, asked in ((no_docs, items), (docs, items.limit(0)), (no_docs, items.limit(0))):
        out = lexical.search(given, asked)
        assert out.columns == ["item_id", "rank", "doc_id", "score", "n_same"] and out.count() == 0


def rebuilt(rows):
    """Rebuilt turn lists by conversation, from rows (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in sorted(((c, t, r or "", x or "") for c, t, r, x in rows if c is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())):
        own[conv].append((role, text))
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
    return out


def plain_trie(told):
    members = collections.defaultdict(list)
    for c in sorted(told):
        for d in range(len(told[c]) + 1):
            members[tuple(told[c][:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1]) if p else 0
    return sorted((
        own[0], len(p), members[p[:-1]][0] if p else -1, len(own), children[p], leaves[p], saved[p],
        hashlib.sha256(",".join(str(c) for c in own if len(told[c]) == len(p)).encode()).hexdigest(),
    ) for p, own in members.items())


def trie_of(spark, tmp_path, rows):
    schema = "conv_id bigint, turn bigint, role string, text string, depth string, name string"
    spark.createDataFrame([(*r, "clash", None) for r in rows], schema).write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries_trie.op13_conversation_prefix_trie(spark, str(tmp_path)).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in out)


def conversations(rng):
    rows = []
    for c in [*range(0, 12), *range(100, 112), 305, 307, -4, -205, 2**63 - 1, -(2**63)]:
        for i in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([i, i, None, 0]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "ü" * 3])))
    rows += [(400 + i, t, "user", "same") for i in range(30) for t in range(6)]
    rows += [rows[0], rows[0], (None, 0, "user", "no conversation"), (None, None, None, None), (500, 0, "user", "x" * 100_000)]
    return rows


def test_trie_equals_plain_prefixes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LISTED", 4)
    rows = conversations(random.Random(5))
    assert trie_of(spark, tmp_path, rows) == plain_trie(rebuilt(rows))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = con.sql(queries_trie.OP13_SQL).fetchall()
    assert sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in found) == plain_trie(rebuilt(rows))


@pytest.mark.parametrize("block", [1, 2, 16])
def test_trie_of_one_deep_conversation(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rng = random.Random(6)
    rows = [(3, i, "user", str(rng.randint(0, 3))) for i in range(150)] + [(103, i, "user", "y") for i in range(5)] + [(4, 0, "user", "z")]
    rows += [(6, t, r, x) for _, t, r, x in rows[:133]]
    assert trie_of(spark, tmp_path, rows) == plain_trie(rebuilt(rows))


def test_trie_of_nothing(spark, tmp_path):
    assert trie_of(spark, tmp_path, [(None, 0, "user", "x")]) == []


def test_trie_of_turnless_conversations(spark, tmp_path):
    rows = [(c, 0, "user", "only") for c in range(101, 140) if zlib.crc32(str(c).encode()) % 6]
    assert trie_of(spark, tmp_path, rows) == plain_trie(rebuilt(rows)) and len(plain_trie(rebuilt(rows))) == 1


def test_machine_scores_all_pairs(spark):
    rng = np.random.default_rng(4)
    model = factorisation.Model(0.3, rng.normal(size=factorisation.DIMENSIONS), rng.normal(size=(factorisation.DIMENSIONS, factorisation.RANK)))
    make = factorisation.Features()
    for text in ("", "one", "Some words, some marks!! | x\nx\nx", "漢字 ü " * 20):
        at, values = make(text, len(text))
        assert len(set(at.tolist())) == len(at)
        pairs = sum(model.pairs[at[i]] @ model.pairs[at[j]] * values[i] * values[j] for i in range(len(at)) for j in range(i))
        assert math.isclose(model.margin(at, values), model.bias + model.weights[at] @ values + pairs, rel_tol=1e-9, abs_tol=1e-9)


def marked(rng, n):
    rows = []
    for i in range(n):
        bad = rng.random() < 0.3
        words = prose(rng, rng.randint(5, 80))
        rows.append((i, words.upper().replace(" ", "!! ") if bad else words, int(not bad)))
    return rows


def test_classifier_learns_and_judges_held_out_texts(spark):
    rng = random.Random(9)
    rows, new = marked(rng, 400), marked(rng, 200)
    docs = spark.createDataFrame([(i, t, len(t)) for i, t, _ in rows], "doc_id bigint, text string, n_chars bigint")
    labels = spark.createDataFrame([(i, q, None) for i, _, q in rows] * 2 + [(0, 5, 1), (1, None, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = factorisation.fit(docs, labels)
    again = factorisation.fit(docs.repartition(3), labels)
    assert np.allclose(model.weights, again.weights) and np.allclose(model.pairs, again.pairs)
    fresh = spark.createDataFrame([(i, t, len(t), "clash") for i, t, _ in new], "doc_id bigint, text string, n_chars bigint, score string")
    found = {r.doc_id: r for r in factorisation.predict(fresh, model).collect()}
    assert sum(found[i].predicted == q for i, _, q in new) >= 0.98 * len(new)
    make = factorisation.Features()
    for i, t, _ in new[:20]:
        assert math.isclose(found[i].score, 1 / (1 + math.exp(-model.margin(*make(t, len(t))))), rel_tol=1e-9)


def test_classifier_bears_awkward_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    found = factorisation.predict(docs, factorisation.fit(docs, labels)).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    scores = collections.defaultdict(set)
    for r in found:
        scores[r.text or "", r.n_chars].add(r.score)
    assert all(len(s) == 1 for s in scores.values())
    none = factorisation.fit(docs, labels.limit(0))
    assert {r.score for r in factorisation.predict(docs, none).collect()} == {0.5}
    assert factorisation.predict(no_docs, none).count() == 0


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    found = queries_ranked.op12_quality_classifier(spark, folder)
    judged = found.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in judged) >= 0.95 * len(judged)
