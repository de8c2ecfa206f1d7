"""The near-copy stage of the pipeline at its own limit."""

import math
import random

import corpus_pipeline
from near_brute import near_components, shingles

from sightline.llm import minhash


def test_pairs_between_80_and_85_go(spark):
    rng, rows, gone = random.Random(4), [], set()
    for k in range(80):
        t = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        u = t[: rng.randrange(164, 176)]
        a, b = shingles(" ".join(t)), shingles(" ".join(u))
        rows += [(2 * k, " ".join(t)), (2 * k + 1, " ".join(u))]
        assert 78 <= 100 * len(a & b) / len(a | b) < 90
        if 100 * len(a & b) >= 80 * len(a | b):
            gone.add(2 * k + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = {r["doc_id"] for r in corpus_pipeline.no_near_copies(spark, docs, "").collect()}
    assert left == {i for i, _ in rows} - gone and gone


def test_parameters_follow_the_limit():
    assert minhash.bands(85) == 10  # 40 minhashes for 100 tables
    shares = []
    for percent in (70, 80, 85, 90):
        m, s, k = minhash.bands(percent), percent / 100, minhash.least_agreeing(percent)
        assert 2 * (1 - s**2) ** m <= 1e-5
        assert sum(math.comb(4 * m, i) * s**i * (1 - s) ** (4 * m - i) for i in range(k)) <= 2e-7
        shares.append(k / (4 * m))
    assert shares == sorted(shares)


def test_keys_are_looked_at_again(spark, monkeypatch):
    """Chains of documents that share most table keys with one they don't link with, small blocks, and stars made before the shuffle."""
    monkeypatch.setattr(minhash, "MANY", 3)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "FLUSH", 900)
    rng, texts = random.Random(12), {}
    for family in range(6):
        base = [f"f{family}w{k}" for k in range(150)]
        for i in range(25):
            t = list(base)
            for j in range(i % 9):
                t[7 + 16 * j] = f"e{i}"
            if i % 4 == 0:
                rng.shuffle(t)
            texts[100 * family + i] = " ".join(t)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_groups(docs).collect()}
    want = near_components(texts)
    assert got == want and len(set(want.values())) > 20


def test_without_id(spark):
    """Rows without an id link with nothing."""
    t = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(5, t), (None, t), (7, t)], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_groups(docs).collect()}
    assert got == {(5, 5, True), (7, 5, False), (None, None, False)}


def test_several_texts_of_one_id(spark):
    """A doc_id with several texts is one document that links by any of them."""
    base = [f"w{k}" for k in range(200)]
    texts = {1: base, 2: base[:180], 3: [f"v{k}" for k in range(90)], 4: [f"v{k}" for k in range(85)]}
    rows = [(i, " ".join(t)) for i, t in texts.items()] + [(2, " ".join([*texts[3], "end"]))] + [(k, " ".join([*base[:100], *(f"u{k}_{j}" for j in range(60))])) for k in range(10, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_groups(docs).collect()}
    assert {k: got[k] for k in texts} == {1: 1, 2: 1, 3: 1, 4: 1} and all(got[k] == k for k in range(10, 20))
