"""Quality rules: base counts, then the divergence of histograms from language references.

Each document has two histograms: of its characters over classes, and of its words over a fixed list
of common words (all others share one bin). The references are the summed histograms of all documents
of a language that have ``MIN_WORDS`` words. A document is kept if its base counts pass and, where it
is long enough to tell, both histograms lie near some language's reference by Jensen-Shannon distance:
that of the characters within a limit, that of the words well below the distance of a text without any
common word. Only DataFrame functions are used; there is no join and no shuffle of rows: the references
are a few numbers a language, gathered in a first pass, and judging is a projection.

Defined results: a null text has no words and fails the base rules; rows keep all their columns and
their number, so repeated rows are judged alike; a null ``lang`` counts as a language of its own; very
long texts are judged whole; with no reference at all (empty table, no long text) the divergence rules pass; columns of the same names
as the results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"
#: Documents with fewer words fail.
MIN_WORDS = 50
#: Percentage of words in repeated windows beyond which a document fails.
MAX_REPEATED = 50
#: The character histogram is compared from so many characters on, the word histogram from so many words.
MIN_CHARS_CLASSES, MIN_WORDS_COMMON = 200, 100
#: Jensen-Shannon distance (base 2, so 0 to 1) of character classes beyond which a document fails.
MAX_CLASS_DISTANCE = 0.3
#: Word distances are shares of the distance that a text without any common word has from the language, which
#: depends on how many such words its texts have. A document fails beyond this share.
MAX_WORD_SHARE = 0.85
#: A language whose texts are nearer than this to a text without common words says nothing about words.
LEAST_WORD_DISTANCE = 0.1
#: Languages are few; more distinct values than this are an error in the data.
MAX_LANGUAGES = 1000
#: Frequent function words of English, German, French and Spanish.
COMMON = (
    "the of and to in is a that it for was on with as at by be this from or an are not "
    "der die und das den von zu mit ist ein eine im für auf dem des sich nicht auch "
    "le la les et un une du que est pour dans qui par sur au avec pas ce "
    "el los las y en que por con para del se lo su más como al"
).split()
COMMON = tuple(dict.fromkeys(COMMON))
CLASSES = ("letter", "capital", "digit", "space", "punctuation", "symbol", "other")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Up to so many windows are sorted as longs, more as structs; a power of two.
POSITIONS = 1 << 24
RESULTS = (*BASE, "class_distance", "word_distance", "base_failed", "kept")
#: Names of working columns; a table's own columns never have them.
W = "__quality_"


def _kept_length(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _histograms(docs: DataFrame) -> DataFrame:
    """Adds the words, the character counts by class and the counts of common words."""
    text = F.col(f"{W}text")
    docs = docs.withColumn(f"{W}text", text_of())
    docs = docs.withColumns({
        f"{W}words": F.regexp_extract_all(text, F.lit(WORD), 0),
        f"{W}rest": F.regexp_replace(text, r"\p{L}+", ""),
        f"{W}small": F.length(F.regexp_replace(text, r"\p{Lu}+", "")),
    })
    rest, n = F.col(f"{W}rest"), F.length(F.col(f"{W}rest"))
    docs = docs.withColumns({
        f"{W}n": F.length(text),
        f"{W}space": n - _kept_length(rest, SPACES),
        f"{W}symbol": n - _kept_length(rest, SYMBOLS),
        f"{W}punctuation": n - _kept_length(rest, PUNCTUATION),
        f"{W}digit": n - _kept_length(rest, "0123456789"),
        f"{W}capital": F.length(text) - F.col(f"{W}small"),
        f"{W}rest_n": n,
        f"{W}found": F.sort_array(F.transform(F.filter(f"{W}words", lambda w: F.lower(w).isin(*COMMON)), F.lower)),
    })
    part = lambda name: F.col(W + name)
    counts = [part("n") - part("rest_n") - part("capital"), *map(part, ("capital", "digit", "space", "punctuation", "symbol"))]
    other = part("rest_n") - part("digit") - part("space") - part("punctuation") - part("symbol")
    # Runs of equal words, by their last positions: the histogram's bins that are not empty.
    found = part("found")
    ends = F.filter(F.sequence(F.lit(1), F.size(found)), lambda i: F.coalesce(F.get(found, i) != F.get(found, i - 1), F.lit(True)))
    ends = F.when(F.size(found) > 0, ends).otherwise(F.array().cast("array<int>"))
    bins = F.lit(list(COMMON))
    docs = docs.withColumns({
        f"{W}classes": F.array(*[c.cast("double") for c in (*counts, other)]),
        f"{W}ends": ends,
    }).withColumn(f"{W}runs", F.transform(f"{W}ends", lambda i: F.struct((F.array_position(bins, F.get(found, i - 1)) - 1).cast("int").alias("bin"), i.alias("end"))))
    runs = part("runs")
    each = F.transform(runs, lambda x, i: F.struct(x["bin"].alias("bin"), (x["end"] - F.coalesce(F.get(runs, i - 1)["end"], F.lit(0))).cast("double").alias("n")))
    rare = F.array(F.struct(F.lit(len(COMMON)).alias("bin"), (F.size(f"{W}words") - F.size(found)).cast("double").alias("n")))
    return docs.withColumn(f"{W}common", F.concat(each, rare))


def references(docs: DataFrame) -> list[tuple[list[float], list[float]]]:
    """Class and word shares of each language, from all its documents of ``MIN_WORDS`` words or more."""
    rows = _histograms(docs.select("lang", "text")).where(F.size(f"{W}words") >= MIN_WORDS)
    # Both histograms as (bin, n), classes with bins below 0: one aggregation of a few rows a document.
    classes = F.transform(f"{W}classes", lambda n, i: F.struct((i - len(CLASSES)).alias("bin"), n.alias("n")))
    made = rows.select("lang", F.explode(F.concat(classes, F.col(f"{W}common"))).alias("x")).groupBy("lang", "x.bin").agg(F.sum("x.n").alias("n"))
    most = MAX_LANGUAGES * (len(CLASSES) + len(COMMON) + 1)
    sums: dict[str | None, dict[int, float]] = {}
    found = made.take(most + 1)
    for lang, at, n in found:
        sums.setdefault(lang, {})[at] = n
    if len(sums) > MAX_LANGUAGES or len(found) > most:
        raise ValueError(f"lang has more than {MAX_LANGUAGES} values")
    out = []
    for lang in sorted(sums, key=lambda x: (x is not None, x or "")):
        own = [[sums[lang].get(i, 0.0) for i in span] for span in (range(-len(CLASSES), 0), range(len(COMMON) + 1))]
        out.append(tuple([x / max(1.0, sum(values)) for x in values] for values in own))
    return out


def _x_log_x(x: float) -> float:
    return x * math.log2(x) if x > 0 else 0.0


def distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance, base 2, of an array of (bin, p), all of p > 0, from given shares q.

    The divergence is the entropy of the mean less the mean of both entropies. Bins that the document
    lacks have the mean q / 2, so their part is that of all bins less that of the document's own.
    """
    q = F.lit(reference)
    halves = [_x_log_x(x / 2) for x in reference]
    lacking = F.lit(halves)

    def step(acc: Column, x: Column) -> Column:
        mean = (x["p"] + F.get(q, x["bin"])) / 2
        return acc + x["p"] * F.log2(x["p"]) / 2 - mean * F.log2(mean) + F.get(lacking, x["bin"])

    start = sum(map(_x_log_x, reference)) / 2 - sum(halves)
    return F.sqrt(F.greatest(F.aggregate(shares, F.lit(start), step), F.lit(0.0)))


def without_common(reference: list[float]) -> float:
    """Distance of a text of rare words alone."""
    q = reference[-1]
    rare = 1 - math.log2(1 + q) + (q + q * math.log2(q / (1 + q)) if q > 0 else 0.0)
    return math.sqrt(max(0.0, (sum(reference[:-1]) + rare) / 2))


def _nearest(name: str, given: list[list[float]], relative: bool = False) -> Column:
    far = [without_common(q) if relative else 1.0 for q in given]
    each = [distance(F.col(f"{W}{name}_shares"), q) / F.lit(x) if x >= LEAST_WORD_DISTANCE else F.lit(0.0) for q, x in zip(given, far, strict=True)]
    return F.least(*each) if len(each) > 1 else each[0] if each else F.lit(0.0)


def _shares(counts: Column, total: Column) -> Column:
    present = F.filter(counts, lambda x: x["n"] > 0)
    return F.transform(present, lambda x: F.struct(x["bin"].alias("bin"), (x["n"] / total).alias("p")))


def judge(docs: DataFrame, known: list[tuple[list[float], list[float]]] | None = None) -> DataFrame:
    """``docs`` with the base counts, both distances, ``base_failed`` and ``kept``."""
    known = references(docs) if known is None else known
    words = F.col(f"{W}words")
    lines = F.filter(F.split(F.col(f"{W}text"), "\n"), lambda x: F.ltrim(x, F.lit(SPACES)) != "")
    first = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    out = _histograms(docs).withColumns({
        f"{W}lines": lines,
        f"{W}chars": F.greatest(F.col(f"{W}n"), F.lit(1)).cast("double"),
        f"{W}number": F.greatest(F.size(words), F.lit(1)).cast("double"),
        f"{W}hashes": F.transform(first, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
    })
    # Windows sorted by the upper bits of their hash, each with its position in the lower ones; equal
    # neighbours are told by the whole hash.
    hashes = F.col(f"{W}hashes")
    placed = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(-POSITIONS)).bitwiseOR(i.cast("bigint"))))
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    fits = F.size(hashes) <= POSITIONS
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
    out = out.withColumns({
        f"{W}windows": F.when(some & fits, placed).otherwise(F.array().cast("array<bigint>")),
        f"{W}pairs": F.when(some & ~fits, pairs).otherwise(F.array().cast("array<struct<hash:bigint,at:int>>")),
    })
    windows = F.col(f"{W}windows")
    position = lambda e: e.bitwiseAND(F.lit(POSITIONS - 1)).cast("int")
    same = lambda e, i: F.coalesce(F.get(hashes, position(e)) == F.get(hashes, position(F.get(windows, i))), F.lit(False))
    twice = F.filter(windows, lambda e, i: same(e, i - 1) | same(e, i + 1))
    pairs = F.col(f"{W}pairs")
    equal = lambda e, i: F.coalesce(e["hash"] == F.get(pairs, i)["hash"], F.lit(False))
    beyond = F.filter(pairs, lambda e, i: equal(e, i - 1) | equal(e, i + 1))
    out = out.withColumn(f"{W}starts", F.concat(F.transform(twice, position), F.transform(beyond, lambda e: e["at"])))
    starts = F.col(f"{W}starts")
    covered = F.array_distinct(F.concat(starts, F.transform(starts, lambda i: i + 1), F.transform(starts, lambda i: i + 2)))
    out = out.withColumns({
        "n_words": F.size(words).cast("bigint"),
        "word_chars": (F.col(f"{W}n") - F.col(f"{W}space")).cast("bigint"),
        "n_symbols": F.col(f"{W}symbol").cast("bigint"),
        "n_dup_lines": (F.size(f"{W}lines") - F.size(F.array_distinct(f"{W}lines"))).cast("bigint"),
        "n_repeat_words": F.size(covered).cast("bigint"),
        f"{W}class_shares": _shares(F.transform(f"{W}classes", lambda n, i: F.struct(i.alias("bin"), n.alias("n"))), F.col(f"{W}chars")),
        f"{W}word_shares": _shares(F.col(f"{W}common"), F.col(f"{W}number")),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    out = out.withColumns({
        "class_distance": F.when(F.col(f"{W}n") >= MIN_CHARS_CLASSES, _nearest("class", [c for c, _ in known])).otherwise(0.0),
        "word_distance": F.when(F.col("n_words") >= MIN_WORDS_COMMON, _nearest("word", [w for _, w in known], True)).otherwise(0.0),
        "base_failed": failed,
    })
    near = (F.col("class_distance") <= MAX_CLASS_DISTANCE) & (F.col("word_distance") <= MAX_WORD_SHARE)
    out = out.withColumn("kept", ~F.col("base_failed") & near)
    return out.drop(*[c for c in out.columns if c.startswith(W)])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps.

    The optimizer would push a filter on ``kept`` below all the steps that lead to it, and so copy
    each step into every one that uses it. A row number, which it may not move, holds the filter in place.
    """
    own = [c for c in docs.columns if c in RESULTS]
    held = docs.withColumnsRenamed({c: f"own {c}" for c in own})
    judged = judge(held).withColumn(f"{W}row", F.monotonically_increasing_id())
    good = judged.where(F.col("kept") & (F.col(f"{W}row") >= 0))
    return good.select(*[F.col(f"`own {c}`").alias(c) if c in own else F.col(f"`{c}`") for c in docs.columns])
