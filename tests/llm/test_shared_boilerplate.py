"""Passages put together of parts that many other documents have, exact and edited."""

import random

import pytest

from sightline.llm import substring_dedup as S


def unlike(rng, n):
    return [f"{rng.choice('bcdfgh')}{rng.randrange(10**7)}" for _ in range(n)]


def corpus(holders, every, both=1, seed=5, cases=10):
    """Per case: documents with one half each, among them `both` with the two halves in a row, and at last one where they are edited. Returns texts, and of each case the last id and those with both."""
    rng = random.Random(seed + holders)
    texts, asked = {}, []
    for _ in range(cases):
        halves = [unlike(rng, 36), unlike(rng, 36)]
        rows = [unlike(rng, 30) + half + unlike(rng, 30) for half in halves for _ in range(holders)]
        whole = [unlike(rng, 30) + halves[0] + halves[1] + unlike(rng, 30) for _ in range(both)]
        rows += whole
        rng.shuffle(rows)
        first = len(texts)
        edited = halves[0] + halves[1]
        if every:
            for k in range(every // 2, len(edited), every):
                edited[k] = f"edit{rng.randrange(10**6)}"
        rows.append(unlike(rng, 30) + edited + unlike(rng, 30))
        for words in rows:
            texts[len(texts)] = " ".join(words)
        asked.append((len(texts) - 1, {first + rows.index(w) for w in whole}))
    return texts, asked


@pytest.mark.parametrize("holders", [16, 200])
@pytest.mark.parametrize(("every", "least"), [(12, 10), (7, 8)])
def test_recall_does_not_hang_on_the_number_of_holders(spark, holders, every, least):
    texts, asked = corpus(holders, every)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    found = {(r["doc_id"], r["owner_id"]) for r in S.repeated_passages(docs).collect()}
    assert sum(any((a, x) in found for x in whole) for a, whole in asked) >= least
    assert {a for a, _ in found} <= {a for a, _ in asked}  # halves alone are too short


def test_many_documents_with_both_halves(spark):
    texts, asked = corpus(40, 12, both=30, cases=4)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = []
    for parts in (1, 4, 16):
        rows = S.repeated_passages(docs.repartition(parts)).collect()
        got.append({(r["doc_id"], r["start"], r["stop"]) for r in rows})
        assert all(a in {r["doc_id"] for r in rows} for a, _ in asked)
    assert {d for d, *_ in got[0]} == {d for d, *_ in got[1]} == {d for d, *_ in got[2]}
