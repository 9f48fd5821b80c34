"""Every registered query against its check SQL in DuckDB, at the smallest scale."""

import math
import os

import pytest

from edgegeom.plans.catalog import QUERIES
from edgegeom.plans.check_sql import CHECKS

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    yield con
    con.close()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x
    return x if isinstance(x, (str, bool)) else float(x)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    columns = sorted(got.columns)
    want = duck.execute(CHECKS[name]).fetchall()
    order = [c[0] for c in duck.description]
    assert sorted(order) == columns
    at = [order.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(
        tuple(plain(r[i]) for i in at) for r in want)


def test_report_buckets_makes_its_edges_once(spark, monkeypatch):
    from edgegeom.plans import catalog

    made, by_flag = [], catalog.by_flag
    monkeypatch.setattr(catalog, "by_flag", lambda *args: made.append(args) or by_flag(*args))
    catalog.report_buckets(spark, SF_DIR)
    assert len(made) == 1
