"""Pages and numbers of rows against a plain sort."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import ordinals as O
from sightline.operators import timeline as L
from sightline.operators import vectors as V


def key(row):
    return tuple((x is not None, x != x, x if x == x else 0) if x is not None else (False, False, 0) for x in row)


@pytest.mark.parametrize("kind", ["spread", "one value", "nulls and nan", "text", "equal"])
def test_pages(spark, kind):
    rng = random.Random(4)
    n = 2_500
    first = {
        "spread": lambda i: float(rng.randrange(10**6)),
        "one value": lambda i: 5.0 if rng.random() < 0.97 else float(rng.randrange(10)),
        "nulls and nan": lambda i: rng.choice([None, float("nan"), 1.0, 2.0, -float("inf"), rng.random()]),
        "text": lambda i: 0.0,
        "equal": lambda i: 1.0,
    }[kind]
    rows = [(first(i), rng.choice(["", "é", "z", None, str(rng.randrange(99))]), i) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b string, id int").repartition(4)
    order = ["b", "id"] if kind == "text" else ["a", "b", "id"]
    at = [2, 1, 0] if kind != "text" else None
    want = [r[2] for r in sorted(rows, key=lambda r: key((r[1], r[2])) if at is None else key(r))]
    for skip, size in ((0, 5), (1234, 24), (n - 7, 24), (600, 900), (n, 5)):
        got = [r["id"] for r in O.rows_at(df, order, skip, size, small=100).collect()]
        assert got == want[skip : skip + size], (kind, skip)
    assert O.rows_at(df.limit(0), order, 0, 5).count() == 0


def test_a_deep_page_sorts_few_rows(spark, tmp_path):
    """The wanted range reaches the scan, and what is sorted is a small share."""
    spark.range(200_000).select((F.col("id") * 7919 % 200_000).alias("k"), "id").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    parts, before = O._narrow(df, ["k"], 150_000, 24, 200_000, 10_000)
    assert sum(p.count() for p in parts) <= 20_000
    plan = parts[0]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k," in plan
    assert [r["k"] for r in L.page(df, ["k"], 150_000 // 24).collect()] == list(range(150_000, 150_024))


def test_numbers(spark):
    new = spark.range(1000).select((F.lit(5000) - F.col("id")).alias("s"))
    stored = spark.range(10).withColumnRenamed("id", "vec_id")
    got = sorted((r["vec_id"], r["s"], r["copy"]) for r in V.number_from(stored, new, ["s"], 2).collect())
    assert got == [(10 + 2 * i + c, 4001 + i, c) for i in range(1000) for c in (0, 1)]
    assert V.number_from(stored, new.limit(0), ["s"]).count() == 0
