"""Every query with SQL against DuckDB on the small tables, and the other queries for their columns."""

import os

import duckdb
import pytest

from sightline.plans import QUERIES, SQL
from sightline.plans.base import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    r = duck.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(r.columns)
    want = sorted(tuple(plain(dict(zip(r.columns, row, strict=True))[c]) for c in cols) for row in r.fetchall())
    got = sorted(tuple(plain(row[c]) for c in cols) for row in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"pca_cluster_filter"}))
def test_others_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def same_as_sql(spark, folder, name, **tables):
    """A query against its SQL on tables of its own."""
    c = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        c.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    df, r = QUERIES[name](spark, str(folder)), c.sql(SQL[name])
    cols = sorted(df.columns)
    want = sorted(tuple(plain(dict(zip(r.columns, row, strict=True))[c]) for c in cols) for row in r.fetchall())
    assert sorted(tuple(plain(row[c]) for c in cols) for row in df.collect()) == want
    return want


def test_only_blanks_are_trimmed_as_in_sql(spark, tmp_path):
    texts = ["a the b.\n", "the\t\n x \n\nthe", "the  \u00a0x\u3000 ", "the", "no", "", None, " the \r\n the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(same_as_sql(spark, tmp_path, "answer_parts", documents=docs)) == len(texts)


@pytest.mark.parametrize("name", ["brand_interval_bounds", "brand_intervals"])
def test_ends_of_intervals_with_ties_beyond_a_million(spark, tmp_path, name):
    """Places are frame * 1000000 + tie in SQL, so event 2,500,000 of frame 10 comes after event 5 of frame 11."""
    rows = [(2_500_000, 1.0), (5, 1.1), (7, 0.7), (5_900_001, 0.5), (3_000_000, 0.6), (9, None)]
    events = spark.createDataFrame([(i, 50, "view", v) for i, v in rows] + [(11, 51, "error", 2.0), (12, 51, "click", None)], "event_id long, user_id long, event_type string, value double")
    events = events.selectExpr("*", "timestamp'2024-01-01 00:00:00' as ts", "'{}' as props")
    if name == "brand_intervals":  # where rows without a frame come among the sources is open
        events = events.where("value is not null")
    want = same_as_sql(spark, tmp_path, name, events=events)
    assert any("0.7" in row and "1.0" in row for row in want)
