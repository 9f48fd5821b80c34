"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are the logarithmic counts of its hashed lower-case words, scaled to length one, and
``STATISTICS`` of its structure and metadata, each a number from 0 to 1 that is split softly between the
two nearest of ``KNOTS`` knots. The machine adds a weight for each feature and, for each pair of features,
the product of two vectors of ``RANK`` numbers. The pairs are never enumerated: their sum is half of the
square of the sum less the sum of the squares, so a text is scored in time linear in its features.

The fit takes at most ``SAMPLE`` distinct texts of each label, those of the smallest hashes, so copies
count once; it runs on the driver over this bounded sample, in small batches with adaptive steps from a
fixed start, and so gives the same model for the same rows. Labels in short supply weigh more. Features of
the sample and all scores are computed in tasks.

Defined results: a null text scores as an empty one, which has statistics but no words; metadata that is
null has a feature of its own; a label other than 0 and 1 is not learned; a label of several rows counts
once, and contradicting labels both count; equal texts of equal metadata have equal scores; very long texts
count whole; without any label every score is 0.5; further columns stay as they are, clashing names are
replaced; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..staging import stage
from .common import text_of

#: Distinct texts of one label that a model is fitted on, at most.
SAMPLE = 4000
#: Hashed words, knots of a statistic, and length of the pair vectors.
WORDS, KNOTS, RANK = 4096, 9, 8
EPOCHS, BATCH, STEP, SHRINK = 12, 64, 0.03, 1e-5
#: A document is kept at this score.
KEEP = 0.3
#: Words whose hash a task keeps; the store is emptied when it is full.
KEPT_WORDS = 400_000
STATISTICS = (
    "empty", "words", "word_length", "symbols", "capitals", "digits", "marks", "exclamations", "bars", "spaces", "beyond_ascii",
    "distinct_words", "top_word", "doubled_words", "capitalised", "ended", "lines", "repeated_lines", "no_metadata", "metadata", "metadata_differs",
)
DIMENSIONS = WORDS + KNOTS * len(STATISTICS)
RESULTS = StructType([StructField("score", DoubleType()), StructField("predicted", IntegerType())])


def _at(*characters: str) -> np.ndarray:
    return np.array([ord(c) for x in characters for c in x])


_SYMBOLS, _DIGITS, _MARKS = _at("#*$%&|<>"), _at("0123456789"), _at(".,;:!?'\"()-")
_UPPER, _LOWER, _SPACES = np.arange(65, 91), np.arange(97, 123), _at(" \t\n\r\x0b\x0c")


class Features:
    """Turns a text and its stated length into (indexes, values) of its features that are not zero."""

    def __init__(self) -> None:
        self.hashes: dict[str, int] = {}

    def _buckets(self, words: list[str]) -> np.ndarray:
        known = self.hashes
        try:
            return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        except KeyError:
            if len(known) > KEPT_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w) % WORDS
            return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def statistics(self, text: str, words: list[str], stated: int | None) -> np.ndarray:
        counts = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
        n_bytes, n = max(1, int(counts.sum())), max(1, len(words))
        lines = [x for x in text.split("\n") if x and not x.isspace()]
        upper, lower = counts[_UPPER].sum(), counts[_LOWER].sum()
        times: dict[str, int] = {}
        for w in words:
            times[w] = times.get(w, 0) + 1
        return np.clip(np.array([
            not words,
            np.log10(1 + len(words)) / 6,
            len(text) / n / 20,
            5 * counts[_SYMBOLS].sum() / n_bytes,
            upper / max(1, upper + lower),
            5 * counts[_DIGITS].sum() / n_bytes,
            5 * counts[_MARKS].sum() / n_bytes,
            10 * counts[33] / n_bytes,
            10 * counts[124] / n_bytes,
            2 * counts[_SPACES].sum() / n_bytes,
            counts[128:].sum() / n_bytes,
            len(times) / n,
            max(times.values(), default=0) / n,
            sum(map(str.__eq__, words, words[1:])) / n,
            sum(w[0].isupper() for w in text.split()) / n,
            2 * sum(w[-1] in ".,;:!?" for w in words) / n,
            5 * len(lines) / n,
            1 - len(set(lines)) / max(1, len(lines)),
            stated is None,
            np.log10(1 + max(0, stated or 0)) / 8,
            stated is not None and stated != len(text),
        ], dtype=np.float64), 0, 1)

    def __call__(self, text: str | None, stated: int | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = text.lower().split()
        at, many = np.unique(self._buckets(words), return_counts=True)
        values = np.log1p(many)
        values /= max(1.0, float(np.sqrt((values**2).sum())))
        place = self.statistics(text, words, stated) * (KNOTS - 1)
        knot = np.minimum(place.astype(np.int64), KNOTS - 2)
        first = WORDS + KNOTS * np.arange(len(STATISTICS)) + knot
        share = place - knot
        indexes = np.concatenate([at, np.column_stack([first, first + 1]).ravel()])
        return indexes, np.concatenate([values, np.column_stack([1 - share, share]).ravel()])


@dataclass(frozen=True)
class Model:
    """Bias, weights and pair vectors."""

    bias: float
    weights: np.ndarray
    pairs: np.ndarray

    def margin(self, at: np.ndarray, values: np.ndarray) -> float:
        """Bias, weights and all pairs of features, by the sum of squares."""
        own = self.pairs[at] * values[:, None]
        sums = own.sum(axis=0)
        return float(self.bias + self.weights[at] @ values + 0.5 * (sums @ sums - (own * own).sum()))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _fitted(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Adaptive steps over small dense batches; only one batch is dense at a time."""
    model = [np.zeros(1), np.zeros(DIMENSIONS), np.random.default_rng(1).normal(0, 0.05, (DIMENSIONS, RANK))]
    if not len(rows):
        return Model(0.0, model[1], np.zeros((DIMENSIONS, RANK)))
    share = np.bincount(labels, minlength=2) / len(labels)
    weigh = 1 / np.sqrt(np.maximum(share, 1e-9))[labels]
    weigh /= weigh.mean()
    squares = [np.zeros_like(x) for x in model]
    rng = np.random.default_rng(2)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for low in range(0, len(rows), BATCH):
            own = order[low : low + BATCH]
            x = np.zeros((len(own), DIMENSIONS))
            for i, r in enumerate(own):
                x[i, rows[r][0]] = rows[r][1]
            x2, sums = x * x, x @ model[2]
            margin = model[0] + x @ model[1] + 0.5 * ((sums**2).sum(axis=1) - x2 @ (model[2] ** 2).sum(axis=1))
            error = (_sigmoid(margin) - labels[own]) * weigh[own] / len(own)
            slopes = [error.sum(keepdims=True), x.T @ error + SHRINK * model[1], x.T @ (error[:, None] * sums) - (x2.T @ error)[:, None] * model[2] + SHRINK * model[2]]
            for value, slope, square in zip(model, slopes, squares, strict=True):
                square += slope * slope
                value -= STEP * slope / (np.sqrt(square) + 1e-8)
    return Model(float(model[0][0]), model[1], model[2])


def fit(docs: DataFrame, labels: DataFrame, metadata: str = "n_chars") -> Model:
    """A model of ``labels(doc_id, quality)`` for the texts of ``docs(doc_id, text)`` and their stated lengths."""
    marked = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    given = docs.select("doc_id", text_of().alias("text"), F.col(metadata).cast("bigint").alias("stated")).withColumn("hash", F.xxhash64("text", "stated"))
    met = stage(given.select("doc_id", "hash").join(marked, "doc_id").groupBy("quality", "hash").agg(F.count(F.lit(1)).alias("n")), "labelled")
    sizes = {r.quality: r.n for r in met.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    # A threshold leaves about twice the sample; the smallest hashes of these are taken.
    place = F.col("hash").bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    share = F.when(F.col("quality") == 0, F.lit(min(1.0, (2 * SAMPLE + 60) / max(1, sizes.get(0, 0))))).otherwise(F.lit(min(1.0, (2 * SAMPLE + 60) / max(1, sizes.get(1, 0)))))
    rank = F.row_number().over(Window.partitionBy("quality").orderBy(place, "hash"))
    sample = stage(met.where(place <= share).withColumn("rank", rank).where(F.col("rank") <= SAMPLE).select("quality", "hash"), "sample")
    texts = given.join(F.broadcast(sample), "hash").groupBy("quality", "hash").agg(F.min(F.struct("text", "stated")).alias("x"))  # 2 * SAMPLE rows at most

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for batch in batches:
            made = [make(t, s) for t, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            lists = [pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["quality", "hash", "at", "values"])

    made = texts.select("quality", "hash", "x.text", "x.stated").mapInArrow(features, "quality int, hash bigint, at array<int>, values array<float>")
    found = made.toArrow().sort_by([("hash", "ascending"), ("quality", "ascending")])
    rows = [(np.asarray(a.values), np.asarray(v.values)) for a, v in zip(found.column("at"), found.column("values"), strict=True)]
    return _fitted(rows, found.column("quality").to_numpy().astype(np.int64))


def predict(docs: DataFrame, model: Model, metadata: str = "n_chars") -> DataFrame:
    """``docs`` with ``score``, from 0 to 1, and ``predicted``, which is 1 from the score ``KEEP`` on."""
    rows = docs.drop(*RESULTS.fieldNames())
    schema = StructType([*rows.schema.fields, *RESULTS.fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS times RANK + 1 numbers
    width = len(rows.columns)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, own = Features(), shared.value
        for batch in batches:
            margins = [own.margin(*make(t, s)) for t, s in zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), strict=True)]
            scores = _sigmoid(np.array(margins, dtype=np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(scores), pa.array((scores >= KEEP).astype(np.int32))], names=schema.fieldNames())

    given = rows.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("text").alias("__text"), F.col(metadata).cast("bigint").alias("__stated"))
    return given.mapInArrow(score, schema)
