"""The metric index against searching everything."""

import os

import numpy as np
import pytest

from sightline.operators import metric_index as M
from sightline.operators import vectors as V
from sightline.plans import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

SCHEMA = "vec_id long, embedding array<float>"


def data(kind, n=1500, dim=12):
    rng = np.random.default_rng(3)
    if kind == "clustered":
        x = rng.normal(size=(25, dim))[rng.integers(25, size=n)] + 0.05 * rng.normal(size=(n, dim))
    elif kind == "equal":  # two thirds of all rows are copies of one
        x = rng.normal(size=(n, dim))
        x[: 2 * n // 3] = x[0]
    else:
        x = rng.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize(("kind", "most"), [("clustered", 0.25), ("unclustered", 1.0), ("equal", 1.0)])
def test_same_as_searching_everything(spark, kind, most):
    x = data(kind)
    g = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(4)
    q = g.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    q, g = (d.withColumn("embedding", d["embedding"].cast("array<double>")) for d in (q, g))
    found, share = M.search(q, g, len(x), 4, 64, V._nearest, True)
    got: dict = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["d2"], r["vec_id"]))
    d2 = M.squared(x.astype(np.float64), x.astype(np.float64))
    np.fill_diagonal(d2, np.inf)
    for i in range(0, len(x), 3):
        want = sorted(d2[i])[:4]
        best = sorted(got[i])[:4]
        assert np.allclose([d for d, _ in best], want, atol=1e-12)
        assert np.allclose(d2[i][[v for _, v in best]], want, atol=1e-12)
    pairs = share["visited"] / (share["blocks"] * len(range(0, len(x), 3)))
    print(kind, "blocks", share["blocks"], "share of pairs visited", round(pairs, 3))
    assert share["blocks"] > 10 and pairs <= most


def test_queries_by_the_index_equal_those_by_broadcast(spark, monkeypatch):
    x = data("clustered", 400)
    g = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (400, None)], SCHEMA)
    q = g.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "query_id")
    one = sorted((r["query_id"], r["rank"], round(r["d2"], 9)) for r in V.knn(q, g, 3).collect())
    monkeypatch.setattr(V, "BROADCAST_BYTES", 1000)
    monkeypatch.setattr(V, "BLOCK", 32)
    assert sorted((r["query_id"], r["rank"], round(r["d2"], 9)) for r in V.knn(q, g, 3).collect()) == one
    few = g.where("vec_id < 3")
    monkeypatch.setattr(V, "BROADCAST_BYTES", 10)
    assert V.knn(q, few, 5).count() == 3 * q.where("query_id is not null and embedding is not null").count()  # fewer rows than asked for


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["knn_topk", "tta_mean_search", "skip_near_duplicates"])
def test_queries_with_the_index(spark, monkeypatch, name):
    one = sorted(map(tuple, QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(V, "BROADCAST_BYTES", 10)
    monkeypatch.setattr(V, "BLOCK", 16)
    assert sorted(map(tuple, QUERIES[name](spark, SF).collect())) == one


@pytest.mark.parametrize("size", [64 << 20, 10])
def test_insertion_in_order(spark, monkeypatch, size):
    """Both against the stored rows and among the new ones, as a loop over the rows does it; with and without blocks."""
    monkeypatch.setattr(V, "BROADCAST_BYTES", size)
    monkeypatch.setattr(V, "BLOCK", 32)
    x = data("clustered", 260, 6).astype(np.float64)
    x[200:] = x[199]  # copies
    limit, kept = 0.9985, []
    stored = list(range(0, 40))
    near = 1 - M.squared(x, x) / 4 >= limit
    for i in range(40, len(x)):
        if not near[i][stored + kept].any():
            kept.append(i)
    rows = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)] + [(None, x[0].tolist(), "n"), (999, None, "n")], "vec_id long, embedding array<double>, brand string").repartition(3)
    got = V.skip_near(rows.where("vec_id >= 40 or vec_id is null"), rows.where("vec_id < 40"), limit, within=True)
    assert sorted(r["vec_id"] for r in got.where("embedding is not null").collect()) == kept and 3 < len(kept) < 220
    assert V.insert_in_order(rows.limit(0), limit).count() == 0


@pytest.mark.parametrize("kind", ["unclustered", "equal", "clustered", "double"])
@pytest.mark.parametrize("own", [True, False])
def test_packs_are_exact_and_send_no_queries_to_blocks(spark, monkeypatch, kind, own):
    """Where blocks cannot be ruled out, no row for each query and block is made; equal vectors go by id."""
    x = data(kind, 700, 9).astype(np.float64)
    x = x + 1e-9 * np.arange(9) if kind == "double" else x  # not in single precision
    x[5] = x[600]
    g = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    q = g.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    monkeypatch.setattr(M, "SPARE", 0)
    monkeypatch.setattr(M, "VISITS", 0)
    monkeypatch.setattr(M.packs, "HELD", 8_000)
    monkeypatch.setattr(M, "_ask", None)
    monkeypatch.setattr(V, "BROADCAST_BYTES", 10)
    monkeypatch.setattr(V, "BLOCK", 40)
    got: dict = {}
    for r in V.knn(q, g, 4, own).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["d2"]))
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    if own:
        np.fill_diagonal(d2, np.inf)
    for i in range(0, 700, 3):
        want = np.lexsort((np.arange(700), d2[i]))[:4]
        assert [v for _, v, _ in sorted(got[i])] == want.tolist()
        assert np.allclose([d for *_, d in sorted(got[i])], d2[i][want], atol=1e-15)
    assert set(got) == set(range(0, 700, 3))


def test_insertion_takes_few_steps_whatever_the_chains(spark, monkeypatch):
    """Every row is near the next one only: rounds over undecided rows would go through the chain link by link."""
    monkeypatch.setattr(V, "BLOCK", 40)
    seen: list[int] = []
    without = V._without_near
    monkeypatch.setattr(V, "_without_near", lambda q, rows, radius, test: (seen.append(rows.count()), without(q, rows, radius, test))[1])
    turn = [i * 0.01 for i in range(400)]
    rows = spark.createDataFrame([(i, [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate(turn)], "vec_id long, embedding array<double>").repartition(3)
    limit = float(1 - (2 * np.sin(0.0055)) ** 2 / 4)
    assert sorted(r["vec_id"] for r in V.insert_in_order(rows, limit).collect()) == list(range(0, 400, 2))
    assert 2 <= len(seen) <= 5 and sum(seen) <= 200
