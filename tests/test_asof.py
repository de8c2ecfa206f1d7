"""Joins by nearest time, and intervals put together from slices, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import asof as A
from sightline.operators import timeline as L
from sightline.operators.slices import with_slices


def best(rows, t, way):
    before = max(((x, c) for x, c in rows if x <= t), default=None)
    behind = min(((x, c) for x, c in rows if x >= t), default=None)
    if way == "backward":
        return before
    if way == "forward":
        return behind
    later = min(((x, c) for x, c in rows if x > t), default=None)
    return later if before is None or (later and later[0] - t < t - before[0]) else before


@pytest.mark.parametrize("limit", [1000, 7])
@pytest.mark.parametrize("way", ["backward", "forward", "nearest"])
def test_as_of(spark, limit, way):
    rng = random.Random(2)
    right = [(rng.choice("aab"), rng.randrange(120), i) for i in range(70)] + [("a", None, 900), (None, 5, 901), ("only", 5, 902)]
    left = [(i, rng.choice("aaab"), rng.randrange(-3, 125)) for i in range(90)] + [(200, None, 5), (201, "a", None), (202, "none", 3)]
    r = spark.createDataFrame(right, "k string, t long, c long")
    d = spark.createDataFrame(left, "id long, k string, t long")
    got = {x["id"]: (x["t_right"], x["c"]) for x in A.as_of(d, r, "t", ["k"], ["c"], way, limit=limit).collect()}
    assert len(got) == len(left)
    for i, k, t in left:
        want = best([(x, c) for key, x, c in right if key == k and x is not None], t, way) if k and t is not None else None
        assert got[i] == (want or (None, None)), (i, k, t)
    near = A.as_of(d, r, "t", ["k"], ["c"], way, tolerance=1, limit=limit).where("c is not null").collect()
    assert {x["id"] for x in near} == {i for i, (x, _) in got.items() if x is not None and abs(x - dict((a, c) for a, _, c in left)[i]) <= 1}
    assert A.as_of(d, r.limit(0), "t", ["k"], ["c"], way, limit=limit).where("c is null").count() == len(left)
    assert A.as_of(d.limit(0), r, "t", ["k"], ["c"], way).count() == 0


def test_slices_hold_about_so_many_rows(spark):
    d = spark.range(10_000).select((F.col("id") % 4).cast("string").alias("k"), F.col("id").alias("t")).where("k in ('0', '1') or t < 100")
    out, slices = with_slices(d, ["k"], F.col("t"), limit=100)
    n = out.groupBy("k", "_slice").count().collect()
    assert max(r["count"] for r in n) < 200 and out.count() == d.count()
    assert {r["k"] for r in slices.collect()} == {"0", "1"}
    edges = out.groupBy("k", "_slice").agg(F.min("t").alias("a"), F.max("t").alias("b")).orderBy("k", "_slice").collect()
    assert all(x["b"] < y["a"] for x, y in zip(edges, edges[1:], strict=False) if x["k"] == y["k"])


def folded(names):
    acc = names[0]
    for x in names[1:]:
        if acc != x:
            acc += ", " + x
    return acc


@pytest.mark.parametrize("limit", [100_000, 5])
def test_intervals_from_slices(spark, limit):
    rng = random.Random(9)
    kinds = {"k1": ["x"], "k2": ["x", "y"], "k3": ["a", "b", "a, b", "a, b, a"], "k4": ["", "a", ", "], "k5": ["a, b", "a"]}
    data = {f"{k}{n}": [rng.choice(v) if rng.random() < 0.5 else v[0] for _ in range(n)] for k, v in kinds.items() for n in (1, 2, 7, 40)}
    data["lead"] = ["a"] * 12 + ["b"] + ["a, b"] * 20 + ["a"] * 3
    rows = [(k, "x", i, 0, float(i), s) for k, names in data.items() for i, s in enumerate(names)]
    d = spark.createDataFrame(rows, "video string, brand string, frame int, tie int, time double, source string").repartition(3)
    got = {r["video"]: r for r in L.brand_intervals(d, ["video", "brand"], limit=limit).collect()}
    for k, names in data.items():
        assert got[k]["source"] == folded(names), k
        assert (got[k]["start"], got[k]["stop"], got[k]["n"]) == (0.0, float(len(names) - 1), len(names))


def test_one_key_with_many_rows(spark):
    """A million rows of one key, in slices."""
    d = spark.range(1_000_000).select(F.lit("v").alias("video"), F.lit("x").alias("brand"), F.col("id").cast("int").alias("frame"), F.lit(0).alias("tie"), F.col("id").cast("double").alias("time"), F.when(F.col("id") < 600_000, "ab").otherwise("c").alias("source"))
    r = L.brand_intervals(d, ["video", "brand"], limit=50_000).first()
    assert (r["start"], r["stop"], r["n"]) == (0.0, 999_999.0, 1_000_000)
    assert r["source"] == "ab" + ", c" * 400_000
