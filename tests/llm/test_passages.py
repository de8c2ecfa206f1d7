"""Repeated passages against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import substring_dedup


def table(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(3)


def some(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def qualify(equal, words, similarity):
    """All [a, b) of at least `words` words with enough equal ones."""
    n = len(equal)
    return [(a, b) for a in range(n) for b in range(a + words, n + 1) if equal[a:b].sum() >= similarity * (b - a) - 1e-9]


def test_stretches_are_whole():
    def blocks(*n):
        return np.concatenate([np.full(k, i % 2 == 0) for i, k in enumerate(n)])

    assert substring_dedup.stretches(blocks(40, 12, 40), 50, 0.8) == [(0, 92)]
    assert substring_dedup.stretches(blocks(20, 5, 20, 5, 20), 50, 0.8) == [(0, 70)]
    rng = np.random.default_rng(1)
    for _ in range(150):
        equal = np.repeat(rng.random(30) < 0.75, rng.integers(1, 8, 30))[:110]
        want, got = qualify(equal, 50, 0.8), substring_dedup.stretches(equal, 50, 0.8)
        assert set(got) <= set(want)
        assert all(any(a < d and c < b for c, d in got) for a, b in want)


def spans(df):
    return {(r["doc_id"], r["owner_id"]) for r in df.collect()}


def test_split_owners(spark):
    """A has the first half of a passage, B the second, C and D both: D repeats C."""
    rng = random.Random(5)
    p = some(rng, 60)
    texts = [some(rng, 40) + part + some(rng, 40) for part in (p[:30], p[30:], p, p)]
    got = spans(substring_dedup.repeated_passages(table(spark, [(i + 1, " ".join(t)) for i, t in enumerate(texts)])))
    assert got == {(4, 3)}


def test_many_holders(spark):
    """Seeds that more than HOLDERS documents have still meet, also across batches of one seed."""
    rng = random.Random(6)
    line, p = some(rng, 10), some(rng, 70)
    texts = [some(rng, 20) + line + some(rng, 20) for _ in range(200)] + [some(rng, 20) + p + some(rng, 20) for _ in range(60)]
    got = spans(substring_dedup.repeated_passages(table(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])))
    assert {d for d, _ in got} == set(range(201, 260)) and min(o for _, o in got) == 200


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_recall(spark, similarity):
    """Every passage with the edits that its similarity allows is found, wherever they are."""
    rng, rows = random.Random(7), []
    for k in range(120):
        n = rng.randrange(50, 90)
        p = some(rng, n)
        q, edits = list(p), int(n * (1 - similarity) + 1e-9)
        for i in rng.sample(range(n), edits) if k % 2 else range(2, n, -(-n // edits)):
            q[i] = f"x{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(some(rng, 60) + p + some(rng, 60))), (2 * k + 1, " ".join(some(rng, 45) + q + some(rng, 70)))]
    assert spans(substring_dedup.repeated_passages(table(spark, rows))) == {(2 * k + 1, 2 * k) for k in range(120)}


def test_words_parted_at_the_edge(spark):
    """What is cut out begins and ends at whole words, though the bytes read around a chain may not."""
    rng, rows, have = random.Random(8), [], {}
    for k in range(8):
        p = ["é" * rng.randrange(1, 30) + str(rng.randrange(10**5)) for _ in range(400)]
        own = [f"vor{k}"] * 3 + some(rng, 5)
        for i, t in enumerate((p[:200], p, own + p + own)):
            rows.append((3 * k + i, " ".join(t)))
            have[3 * k + i] = set(t)
    left = {r["doc_id"]: r["text"] for r in substring_dedup.remove_passages(table(spark, rows)).collect()}
    assert all(set(left[k].split()) <= have[k] for k in have) and len(left[2].split()) <= 16


def test_texts_under_one_id(spark):
    """Each text of a doc_id is searched and cut by itself."""
    rng = random.Random(9)
    p, q = some(rng, 60), some(rng, 70)
    first, second = some(rng, 30) + p + some(rng, 5), some(rng, 11) + q + some(rng, 50)
    rows = [(1, " ".join(some(rng, 20) + p)), (2, " ".join(q + some(rng, 9))), (3, " ".join(first)), (3, " ".join(second)), (3, " ".join(second))]
    docs = table(spark, rows)
    assert {(3, 1), (3, 2)} == spans(substring_dedup.repeated_passages(docs))
    left = sorted(r["text"].split() for r in substring_dedup.remove_passages(docs).where(F.col("doc_id") == 3).collect())
    assert left == sorted([first[:30] + first[90:], second[:11] + second[81:], second[:11] + second[81:]])


def test_packed_seeds():
    rng = np.random.default_rng(3)
    ids = rng.integers(-(2**62), 2**62, (5, 2))
    which = np.sort(rng.choice([0, 2, 4], 300))
    place = np.concatenate([np.sort(rng.integers(0, 9000, (which == k).sum())) for k in (0, 2, 4)])
    place = (place << 32) + 7 * place
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    got = substring_dedup.unpack(substring_dedup.pack(h, which, place, ids), 9)
    assert (got[0] == (h & np.uint64(2**48 - 1)).astype(np.int64) + (9 << 48)).all()
    assert (got[1] == ids[which, 0]).all() and (got[2] == ids[which, 1]).all() and (got[3] == place).all()
