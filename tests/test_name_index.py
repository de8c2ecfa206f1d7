"""The index of names against scoring every name."""

import random

import pytest

from sightline.functions import similarity as S
from sightline.operators import matching as M
from sightline.operators.name_index import NameIndex

ADJECTIVES = "small red blue hot cold large old new almond antique burlywood chiffon dim forest ghost honeydew ivory khaki lace maroon".split()
NOUNS = "ring widget bolt gear gizmo plate nut screw chain spring lever valve pump motor wheel frame".split()
ODD = ["", " ", "a", "ab", "abc", "  two  blanks ", "x1y2", "12ab", "İstanbul ß", "same same same", "Brand#12", "ring small", "日本語 ring", "a b", "b a"]


def names(rng, n):
    return sorted({" ".join([rng.choice(ADJECTIVES), *rng.sample(NOUNS, rng.randrange(1, 3))]) + (str(rng.randrange(40)) if rng.random() < 0.4 else "") for _ in range(n)})


def typo(rng, name):
    t = list(name)
    for _ in range(rng.randrange(0, 3)):
        k = rng.randrange(len(t))
        t[k : k + rng.randrange(2)] = rng.choice(["", "x", "e", " "])
    return "".join(t)


@pytest.mark.parametrize("scorer", sorted(S.SCORERS))
def test_best_is_that_of_a_double_loop(scorer):
    rng = random.Random(4)
    listed = names(rng, 200) + ODD
    index = NameIndex(listed, scorer)
    f = S.SCORERS[scorer]
    for q in [typo(rng, rng.choice(listed[:150])) for _ in range(60)] + ODD + ["zzz", "qqqqqq wwww"]:
        scores = [f(q, y) for y in listed]
        bound = index.bounds(q)
        assert all(s <= b for s, b in zip(scores, bound, strict=True)), (q, [(y, s, b) for y, s, b in zip(listed, scores, bound, strict=True) if s > b])
        best, at = index.best(q)
        assert (best, at) == (max(scores), scores.index(max(scores))), q


@pytest.mark.parametrize("scorer", ["ratio", "wratio", "token_sort_ratio"])
def test_few_pairs_are_scored(scorer):
    rng = random.Random(5)
    listed = names(rng, 4000)
    index = NameIndex(listed, scorer)
    asked = [typo(rng, rng.choice(listed)) for _ in range(200)]
    for q in asked:
        index.best(q)
    assert index.scored < 0.1 * len(asked) * len(listed)


def test_blocks_give_the_same_as_one_list(spark, monkeypatch):
    rng = random.Random(6)
    listed = names(rng, 120)
    asked = [(typo(rng, rng.choice(listed)),) for _ in range(40)] + [(None,), ("",)]
    q, b = spark.createDataFrame(asked, "q string"), spark.createDataFrame([(n,) for n in listed] + [(None,)], "brand string")
    one = sorted(map(tuple, M.best_match(q, "q", b, "brand", "wratio", 80.0).collect()), key=str)
    monkeypatch.setattr(M, "MOST_BYTES", 100)
    monkeypatch.setattr(M, "BLOCK", 17)
    assert sorted(map(tuple, M.best_match(q, "q", b, "brand", "wratio", 80.0).collect()), key=str) == one
    assert M.best_match(q, "q", b.limit(0), "brand", "wratio", 80.0).count() == 0


def test_names_that_bounds_leave_are_scored_side_by_side(monkeypatch):
    """Numbered names are nearly all within each other's bounds; scored one by one they took minutes."""
    rng = random.Random(7)
    listed = sorted(f"supplier#{i * 7:09} {rng.choice(ADJECTIVES)}" for i in range(300)) + ODD
    asked = [f"customer#{rng.randrange(10**6):09} {rng.choice(NOUNS)}" for _ in range(40)] + ODD + ["y" * 63 + "ß", "supplier#" * 9, listed[9]]
    index = NameIndex(listed, "ratio")
    got = index.best_of_each(asked)
    assert index.scored <= len(listed)  # the one text of more than 64 letters
    for q, found in zip(asked, got, strict=True):
        scores = [S.ratio(q, y) for y in listed]
        assert found == (max(scores), scores.index(max(scores))), q
    assert NameIndex([], "ratio").best_of_each(["a"]) == [None] and NameIndex([""], "ratio").best_of_each(["", "a"]) == [(100.0, 0), (0.0, 0)]
