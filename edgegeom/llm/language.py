"""Language identification by nearest centroids of TF-IDF vectors of byte n-grams.

A text becomes a vector of ``DIMENSIONS`` hashed counts of 1- to 3-grams of its lower-case letters,
damped by a square root, weighted by inverse document frequency and scaled to length 1. Every language
has up to ``CLUSTERS`` centroids, found by spherical k-means on a sample of at most
``SAMPLE_PER_LANGUAGE`` distinct texts of it and ``SAMPLE_ROWS`` in all; document frequencies come from all training
rows. A text takes the language of the centroid of largest cosine. It is rejected if it is farther
from that centroid than any sampled text of the language from its nearest, by more than ``SLACK``.

Defined results: a null text or one without a letter is ``und``, score 0 and rejected; equal cosines go to
the first language by name; very long texts count whole; an empty table gives no rows; a model without
any labelled row calls every text ``und`` and rejects only texts without a letter; equal texts get
equal results; rows keep their number and other columns, columns named as the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

DIMENSIONS = 4096
CLUSTERS = 4
SAMPLE_PER_LANGUAGE = 500
#: Sampled texts in all; shared by the languages if these are many.
SAMPLE_ROWS = 6000
ITERATIONS = 12
SLACK = 0.02
UNKNOWN = "und"
RESULTS = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])


@dataclass(frozen=True)
class Model:
    """Centroids (rows of length 1), their languages and radii, and the weight of each dimension."""

    languages: tuple[str, ...]
    centroids: np.ndarray
    radii: np.ndarray
    idf: np.ndarray


def has_letter(text: str | None) -> bool:
    return bool(text) and regex.search(r"\p{L}", text) is not None


def _letters() -> bytes:
    """Byte map: all of ASCII but letters becomes a space; bytes of longer code points stay."""
    return bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def counts(text: str | None) -> np.ndarray:
    """Hashed counts of the byte 1- to 3-grams of a text."""
    raw = b" " + " ".join((text or "").lower().encode("utf-8", "replace").translate(_LETTERS).decode("latin-1").split()).encode("latin-1") + b" "
    one = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    two = one[:-1] * np.uint32(256) + one[1:]
    three = two[:-1] * np.uint32(256) + one[2:]
    codes = np.concatenate([one, two + np.uint32(1 << 25), three + np.uint32(1 << 26)])
    return np.bincount((codes * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMENSIONS)


_LETTERS = _letters()


def vector(text: str | None, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts(text)) * idf
    norm = float(np.sqrt(v @ v))
    return (v / norm if norm else v).astype(np.float32)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DIMENSIONS, dtype=np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            total += counts(text) > 0
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["at", "n"])


def _cluster(rows: np.ndarray, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from a farthest-first start; centroids and each row's cosine to its own."""
    centres = [rows.mean(axis=0)]
    for _ in range(min(clusters, len(rows)) - 1):
        nearest = np.max(rows @ np.array(centres).T, axis=1)
        centres.append(rows[int(np.argmin(nearest))])
    centres = np.array(centres)
    for _ in range(ITERATIONS):
        norms = np.linalg.norm(centres, axis=1, keepdims=True)
        centres = centres / np.where(norms > 0, norms, 1)
        own = np.argmax(rows @ centres.T, axis=1)
        centres = np.array([rows[own == i].mean(axis=0) if np.any(own == i) else c for i, c in enumerate(centres)])
    norms = np.linalg.norm(centres, axis=1, keepdims=True)
    centres = centres / np.where(norms > 0, norms, 1)
    return centres, rows @ centres.T


def fit(train: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of the texts with a language; reads no other column."""
    train = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    place = (F.xxhash64("text").bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))).alias("at")
    hashes = train.select("lang", place).groupBy("lang", "at").agg(F.count(F.lit(1)).alias("n"))
    made = hashes.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"), F.min("at").alias("least")).limit(SAMPLE_ROWS + 1).collect()
    sizes = {r.lang: r.n for r in made}
    if not sizes:
        return Model((), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0), np.ones(DIMENSIONS))
    if len(sizes) > SAMPLE_ROWS:
        raise ValueError(f"{lang} has more than {SAMPLE_ROWS} values")
    found = train.select("text").mapInArrow(_document_frequencies, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    idf = np.zeros(DIMENSIONS)
    n = sum(sizes.values())
    idf[:] = np.log(1 + n)
    for at, df in found:
        idf[at] = np.log((1 + n) / (1 + df)) + 1e-3
    each = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE_ROWS // len(sizes)))
    # A hash threshold leaves a few times the wanted texts of each language, and its least hash in any case; copies
    # have one hash, so the share is of distinct hashes. The smallest hashes of these are taken.
    share = F.create_map(*[F.lit(x) for r in made for x in (r.lang, max(r.least, min(1.0, (4 * each + 60) / r.texts)))])
    picked = train.select("lang", "text", place).where(F.col("at") <= F.element_at(share, F.col("lang")))
    picked = picked.groupBy("lang", "at").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("at")
    picked = picked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [vector(t, idf).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["lang", "vector"])

    rows: dict[str, list[np.ndarray]] = {}
    for name, made in picked.select("lang", "text").mapInArrow(vectors, "lang string, vector binary").collect():  # SAMPLE_ROWS at most
        rows.setdefault(name, []).append(np.frombuffer(made, dtype=np.float32))
    languages, centroids, radii = [], [], []
    for name in sorted(rows):
        own = np.array(sorted(rows[name], key=lambda v: v.tobytes()), dtype=np.float64)
        centres, cosines = _cluster(own, CLUSTERS)
        radius = 1 - float(cosines.max(axis=1).min()) + SLACK
        for c in centres:
            languages.append(name)
            centroids.append(c)
            radii.append(radius)
    return Model(tuple(languages), np.array(centroids, dtype=np.float32), np.array(radii), idf)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine to the nearest centroid) and ``rejected``."""
    kept = docs.drop(*RESULTS.fieldNames())
    schema = StructType([*kept.schema.fields, *RESULTS.fields])
    at = kept.columns.index(text)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, rejected = [], [], []
            for value in batch.column(at).to_pylist():
                if not has_letter(value):
                    name, score, out = UNKNOWN, 0.0, True
                elif not model.languages:
                    name, score, out = UNKNOWN, 0.0, False
                else:
                    cosines = model.centroids @ vector(value, model.idf)
                    best = int(np.argmax(cosines))
                    score = min(1.0, max(0.0, float(cosines[best])))
                    name, out = model.languages[best], 1 - score > model.radii[best]
                names.append(name)
                scores.append(score)
                rejected.append(bool(out))
            made = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.fieldNames())

    return kept.mapInArrow(label, schema)
