"""Small tables with the awkward cases that every operator must bear."""

import random

import pytest

WORDS = "the of and to in is that alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def awkward_texts(rng: random.Random) -> list[str | None]:
    base = prose(rng, 120)
    near = base.replace("alpha", "omega", 1)
    shared = prose(rng, 90)
    return [
        None, "", " \n\t ", "one", "two words", base, base, near, base.upper(), shared + " x " + prose(rng, 40),
        prose(rng, 30) + " " + shared, "ab " * 400, "ÄÖÜ ß é ñ 漢字 😀 " * 30, "#*$ %&| <>" * 20, "a\n\nb\na\n \na", "x" * 5000,
        "".join(rng.choice("abc \n") for _ in range(3000)), prose(rng, 4000), *[prose(rng, rng.randint(1, 200)) for _ in range(30)],
    ]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls in any column, repeated rows, ties, very long texts and clashing names."""
    rng = random.Random(7)
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", None]), len(t or ""), i, "kept") for i, t in enumerate(awkward_texts(rng))]
    rows += [rows[5], rows[5], (None, "text without an id", "en", None, 18, None, None), (3, "other text of a used id", None, "s1", None, 1, "k"), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, kept string")


@pytest.fixture(scope="session")
def no_docs(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="session")
def tables(spark, docs, no_docs, tmp_path_factory):
    """Folders with a documents table: ``some`` and ``none``."""
    root = tmp_path_factory.mktemp("tables")
    for name, df in (("some", docs), ("none", no_docs)):
        df.write.parquet(f"{root}/{name}/documents.parquet")
    return root
