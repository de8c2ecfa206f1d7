"""Blocks of near vectors in bounded memory, and pivots without a sort of all rows."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from sightline.llm import embedding_dedup as E


def block(x, first=0):
    codes, factor = E.encode(x)
    return {"id": np.arange(first, first + len(x)), "n": np.ones(len(x), np.int64), "vector": x, "code": codes, "factor": factor}


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_a_full_block_of_near_vectors():
    """16,384 rows that all link: 134 million links, counted and joined without being held."""
    rng = np.random.default_rng(1)
    x = unit(np.ones(16) + 0.01 * rng.standard_normal((16_384, 16)))
    b = block(x)
    tracemalloc.start()
    ids, links, root = E.summed(b, None, 0.95)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (links == len(x) - 1).all() and (root == 0).all() and peak < 100 << 20


def test_sums_are_those_of_all_pairs(monkeypatch):
    rng = np.random.default_rng(2)
    x = unit(rng.standard_normal((30, 8))[rng.integers(30, size=400)] + 0.08 * rng.standard_normal((400, 8)))
    n = rng.integers(1, 4, 400)
    monkeypatch.setattr(E, "STRIP", 500)
    near = x @ x.T >= 0.95
    for split in (None, 150):
        a, b = block(x[:split] if split else x, 1000), block(x[split:], 5) if split else None
        for part, of in ((a, n[:split] if split else n), (b, n[split:] if split else None)):
            if part:
                part["n"] = of
        ids, links, root = E.summed(a, b, 0.95)
        ok = near.copy()
        if split:  # links across only
            ok[:split, :split] = ok[split:, split:] = False
        np.fill_diagonal(ok, False)
        assert np.array_equal(links, ok @ n)
        label = ids.copy()
        while True:
            new = np.array([min([label[i], *label[ok[i]]]) for i in range(len(ids))])
            if (new == label).all():
                break
            label = new
        assert np.array_equal(root, label)


def test_pivots_are_the_least_hashes(spark):
    rows = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, 2).otherwise(3).alias("size"), F.encode(F.lpad(F.col("id").cast("string"), 16, "0"), "utf-8").alias("vector"))
    got = E.pivots_of(rows, 2000)
    for size in (2, 3):
        want = [r["vector"] for r in rows.where(F.col("size") == size).orderBy(F.xxhash64("id")).limit(2000).collect()]
        assert [v.tobytes() for v in got[size]] == [bytes(v) for v in want]
    assert E.pivots_of(rows.limit(0), 5) == {}
