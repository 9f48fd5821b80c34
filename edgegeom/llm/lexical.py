"""Ranked lexical search over bags of words, each different bag scored once.

1. Documents are restricted to the items' vocabulary: a row keeps its number of terms and a vector of
   (term, times) of the vocabulary's terms alone. A vocabulary of at most ``VOCABULARY`` terms goes to the
   tasks; a larger one is joined to the documents' terms, which gives the same vectors.
2. Counts over all documents give each term's weight, and with them a document's length term m.
3. Documents of equal vector and m have equal scores for every item. They are grouped by a hash and
   verified by the vector and m themselves; a class keeps its size and least doc_id.
4. Classes are scored once, against blocks of items of bounded size. A task holds one block's postings and
   each item's best classes so far; only these leave the task.
5. The best ``k`` classes of an item hold its best ``k`` documents, as a class outranks another by score,
   then by least doc_id. Their members are found through the hash, verified, and expanded by ascending
   doc_id, at most ``k`` of each class.

A term is a maximal run of digits, letters of ASCII and all characters beyond it; only A to Z are lowered.

Defined results: a null text has no term, and a document without terms is not counted and never found;
every row of a table is a document or an item of its own, also if its id repeats or is null; equal scores
go by ascending doc_id, null last; items without a term or match have no rows; very long texts count
whole; other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .common import text_of

#: Vocabulary terms, and their bytes, that every task may hold; more are joined.
VOCABULARY, VOCABULARY_BYTES = 1 << 18, 1 << 23
#: Postings of a block of items, and cells of scores that a task holds at a time.
POSTINGS, CELLS = 1 << 20, 1 << 21
#: Parts of a thousand in the length term, and the unit of scores.
BASE, SLOPE, UNIT = 25, 75, 1_000_000_000

_FOLD = bytes((c | 0x20 if 0x41 <= c <= 0x5A else c) if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def terms_of(data: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return (data or b"").translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``row, id, n, terms, times`` of every text, with all its terms."""
    for batch in batches:
        n, terms, times = [], [], []
        for data in batch.column(2).to_pylist():
            counts: dict[bytes, int] = {}
            own = terms_of(data)
            for t in own:
                counts[t] = counts.get(t, 0) + 1
            n.append(len(own))
            terms.append(list(counts))
            times.append(list(counts.values()))
        made = [pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], ["row", "id", "n", "terms", "times"])


def _all_terms(rows: DataFrame, key: str) -> DataFrame:
    given = rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), text_of().cast("binary").alias("data"))
    return given.mapInArrow(_bags, "row bigint, id bigint, n bigint, terms array<binary>, times array<bigint>")


def _restricted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, times`` with the numbers of the vocabulary's terms, ascending."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            n, terms, times, at = [], [], [], [0]
            for data in batch.column(1).to_pylist():
                own = terms_of(data)
                n.append(len(own))
                found = np.array([x for x in map(number.get, own) if x is not None], dtype=np.int64)
                found, many = np.unique(found, return_counts=True)
                terms.append(found)
                times.append(many)
                at.append(at[-1] + len(found))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([*x, np.zeros(0, np.int64)]), pa.int64())) for x in (terms, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])

    given = docs.select("doc_id", text_of().cast("binary").alias("data"))
    return given.mapInArrow(count, "doc_id bigint, n bigint, terms array<bigint>, times array<bigint>")


def _joined(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The same rows for a vocabulary of any size: every term of every document is looked up by a join."""
    bags = stage(_all_terms(docs, "doc_id"), "bags")
    each = bags.select("row", F.explode(F.arrays_zip("terms", "times")).alias("x")).select("row", F.col("x.terms").alias("term"), F.col("x.times").alias("times"))
    met = each.join(vocabulary, "term").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("number", "times"))).alias("v"))
    found = bags.select("row", F.col("id").alias("doc_id"), "n").join(met, "row", "left")
    none = F.array().cast("array<bigint>")
    return found.select("doc_id", "n", F.coalesce("v.number", none).alias("terms"), F.coalesce("v.times", none).alias("times"))


class _Block:
    """Postings of some items: for each term its weight and the items that have it."""

    def __init__(self, postings: pa.Table, n_docs: int):
        rows, numbers, times, dfs = (postings.column(c).to_numpy() for c in ("row", "number", "times", "df"))
        self.items, item = np.unique(rows, return_inverse=True)
        order = np.argsort(numbers, kind="stable")
        self.terms, self.starts = np.unique(numbers[order], return_index=True)
        self.starts = np.append(self.starts, len(numbers))
        self.item, self.times = item[order], times[order]
        self.weights = np.array([weight(n_docs, int(df)) for df in dfs[order][self.starts[:-1]]], dtype=np.int64)

    def scores(self, owner: np.ndarray, terms: np.ndarray, times: np.ndarray, m: np.ndarray) -> np.ndarray:
        """A score for each class (``m`` has one entry a class) and item."""
        out = np.zeros((len(m), len(self.items)), dtype=np.int64)
        at = np.searchsorted(self.terms, terms)
        known = self.terms[np.minimum(at, len(self.terms) - 1)] == terms
        at, owner, times = at[known], owner[known], times[known]
        gain = self.weights[at] * (UNIT * times // (1000 * times + 8 * m[owner]))
        sizes = self.starts[at + 1] - self.starts[at]
        first = np.repeat(self.starts[at] - np.cumsum(sizes) + sizes, sizes)
        posting = first + np.arange(len(first))
        np.add.at(out, (np.repeat(owner, sizes), self.item[posting]), np.repeat(gain, sizes) * self.times[posting])
        return out


def _best(block: _Block, k: int):
    """The best classes of each item among those of a task: ``row, score, class, least``."""
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_items = len(block.items)
        held = [np.zeros((0, 4), dtype=np.int64)] * n_items  # score, no doc_id, doc_id, class
        bar = np.ones(n_items, dtype=np.int64)
        step = max(1, CELLS // n_items)
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                lists = part.column(3)
                sizes = np.diff(lists.offsets.to_numpy())
                terms, times = lists.flatten().to_numpy(), part.column(4).flatten().to_numpy()
                owner = np.repeat(np.arange(part.num_rows), sizes)
                scores = block.scores(owner, terms, times, part.column(2).to_numpy())
                least = part.column(1)
                ids = np.stack([least.is_null().to_numpy(zero_copy_only=False).astype(np.int64), least.fill_null(0).to_numpy(), part.column(0).to_numpy()], axis=1)
                for i in np.flatnonzero((scores >= bar).any(axis=0)):
                    new = np.flatnonzero(scores[:, i] >= bar[i])
                    rows = np.concatenate([held[i], np.column_stack([scores[new, i], ids[new]])])
                    held[i] = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[:k]]
                    if len(held[i]) == k:
                        bar[i] = held[i][-1, 0]
        rows = np.concatenate([*held, np.zeros((0, 4), np.int64)])
        item = np.repeat(block.items, [len(h) for h in held])
        least = pa.array(rows[:, 2], mask=rows[:, 1] == 1)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(rows[:, 0]), pa.array(rows[:, 3]), least], ["row", "score", "class", "least"])

    return best


def _rank(by: str, *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(*order))


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score, n_same`` of each item's ``k`` best documents of positive score.

    ``n_same`` is the number of documents with the same vector and m.
    """
    asked = stage(_all_terms(items, "item_id"), "items")
    wanted = asked.select("row", F.explode(F.arrays_zip("terms", "times")).alias("x")).select("row", F.col("x.terms").alias("term"), F.col("x.times").alias("times"))
    vocabulary = stage(wanted.select("term").distinct().withColumn("number", F.monotonically_increasing_id()), "vocabulary")
    size, n_bytes = vocabulary.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    if size <= VOCABULARY and n_bytes <= VOCABULARY_BYTES:
        vectors = _restricted(docs, {bytes(r.term): r.number for r in vocabulary.collect()})
    else:
        vectors = _joined(docs, vocabulary)
    vectors = stage(vectors.where("n > 0"), "vectors")
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(1))).first()
    counts = vectors.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("df"))

    m = F.expr(f"CAST(CAST({SLOPE} * n AS DECIMAL(19,0)) * {n_docs} div {n_terms} AS BIGINT)") + BASE
    held = vectors.where(F.size("terms") > 0).withColumn("m", m).withColumn("hash", F.xxhash64("m", "terms", "times"))
    same = ["hash", "m", "terms", "times"]
    classes = held.groupBy(*same).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_same"))
    classes = stage(classes.withColumn("class", F.monotonically_increasing_id()), "classes")

    postings = stage(wanted.join(vocabulary, "term").join(counts, "number").select("row", "number", "times", "df"), "postings")
    blocks = max(1, -(-postings.count() // POSTINGS))
    given = classes.select("class", "least", "m", "terms", "times")
    found = []
    for i in range(blocks):
        block = postings.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == i).toArrow()
        if block.num_rows:
            found.append(given.mapInArrow(_best(_Block(block, n_docs), k), "row bigint, score bigint, class bigint, least bigint"))
    if not found:
        return asked.where("false").select(F.col("id").alias("item_id"), F.lit(0).alias("rank"), F.col("id").alias("doc_id"), F.col("n").alias("score"), F.col("n").alias("n_same"))
    best = reduce(DataFrame.union, found)
    best = best.withColumn("at", _rank("row", F.desc("score"), F.asc_nulls_last("least"))).where(F.col("at") <= k)
    best = stage(best.select("row", "score", "class"), "best")

    chosen = classes.join(best.select("class").distinct(), "class", "left_semi").select("class", "n_same", *same)
    members = held.join(chosen.select("hash").distinct(), "hash", "left_semi").join(chosen, same).select("class", "n_same", "doc_id")
    members = members.withColumn("at", _rank("class", F.asc_nulls_last("doc_id"))).where(F.col("at") <= k).drop("at")
    ranked = best.join(members, "class").withColumn("rank", _rank("row", F.desc("score"), F.asc_nulls_last("doc_id"))).where(F.col("rank") <= k)
    return ranked.join(asked.select("row", F.col("id").alias("item_id")), "row").select("item_id", "rank", "doc_id", "score", "n_same")
