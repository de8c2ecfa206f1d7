"""Periodic runs, divergence of sources and toxicity: brute force, odd tables, held-out accuracy."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import divergence as D
from sightline.llm import language_id, toxicity
from sightline.llm import periods as P

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def brute_runs(w, times, shortest):
    """Every stretch with a period that cannot go on, whose period is its smallest."""
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size, s = j + q - i, w[i : j + q]
            if size >= max(shortest, times * q) and not any(s[: size - d] == s[d:] for d in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def odd_text(rng):
    t = [rng.choice("abcde"[: rng.choice([1, 2, 2, 3, 5])]) for _ in range(rng.randrange(0, 90))]
    if rng.random() < 0.6 and t:
        a = rng.randrange(len(t))
        p = 1 + (len(t) - a) // rng.randrange(3, 11)
        t = [t[i] if i < a else t[a + (i - a) % p] for i in range(len(t))]
    if rng.random() < 0.2:
        u, v = ["a"], ["a", "b"]
        for _ in range(7):
            u, v = v, v + u
        t = v
    return t


@pytest.mark.parametrize(("times", "shortest"), [(4, 6), (2, 2), (3, 4)])
def test_runs_are_those_of_brute_force(times, shortest, monkeypatch):
    rng = random.Random(times)
    for trial in range(150):
        monkeypatch.setattr(P, "FEW", rng.choice([0, 2, 64]))
        monkeypatch.setattr(P, "WAITING", rng.choice([4, 64, 4096]))
        texts = [odd_text(rng) for _ in range(rng.randrange(1, 7))]
        got = defaultdict(list)
        for k, *run in zip(*(x.tolist() for x in P.runs_of(texts, times, shortest)), strict=True):
            got[k].append(tuple(run))
        assert [got[k] for k in range(len(texts))] == [brute_runs(t, times, shortest) for t in texts], trial


def test_a_long_text_takes_few_moves():
    n = 40_000
    rng = random.Random(1)
    words = [str(rng.randrange(500)) for _ in range(n)]
    period = 1 + (n - 1000) // 7
    words = [words[i] if i < 1000 else words[1000 + (i - 1000) % period] for i in range(n)]
    _, start, length, q = P.runs_of([words, ["same"] * n], 4, 6)
    assert list(zip(start.tolist(), length.tolist(), q.tolist(), strict=True)) == [(1000, n - 1000, period), (0, n, 1)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(doc, text):
    w, h = words_of(text), zlib.crc32(b"" if doc is None else str(doc).encode())
    if h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests(spark, docs, texts, empty):
    more = spark.createDataFrame([(i, " ".join(map(str, range(i % 13, 60)))) for i in range(100, 160)] + [(None, "x y z " * 4), (200, "é b \x0b" * 9)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(more).unionByName(more.where("doc_id = 100"))
    got = Counter(tuple(r) for r in P.summarise(P.find_runs(P.with_planted(rows))).collect())
    want = Counter()
    for r in rows.collect():
        w = planted(r["doc_id"], r["text"])
        runs = brute_runs(w, 4, 6) if len(w) < 10_000 else []
        keep = [True] * len(w)
        for s, n, q in runs:
            keep[s + q : s + n] = [False] * (n - q)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        best = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[(r["doc_id"], len(runs), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for x, k in zip(w, keep, strict=True) if k)))] += 1
    assert got == want and sum(n for x, n in got.items() if x[1]) > 5
    assert P.summarise(P.find_runs(P.with_planted(empty))).count() == 0
    found = {r["doc_id"]: r for r in P.find_runs(docs).collect()}
    assert found[15]["collapsed"] == "a" and [tuple(x) for x in found[15]["runs"]] == [(0, 3000, 1)]
    assert (found[1]["n_words"], found[1]["runs"], found[1]["collapsed"]) == (0, [], "")


def brute_audit(rows, least, top):
    """lang, source, part, item, value, rank by plain loops; rows: (lang, source, text)."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(of, kept=kept):
            n = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            term = sorted((whole[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > whole[t])[:top]
            for part, ranked in (("pair", pair), ("term", term)):
                out |= {(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(ranked, 1)}
    return out


def test_divergence(spark, empty, monkeypatch):
    rng = random.Random(8)
    words = ["stone", "River", "ÉTÉ", "été", "日本", "a", "it's", "x1y", "KK", "zoo"]
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "S3", None, "s4"]), rng.choice([None, "", " ".join(rng.choices(words, weights=range(1, 11), k=rng.randrange(30)))])) for _ in range(300)]
    rows += [("xx", "s1", "once"), ("xx", "s2", None), ("lone", "s1", "a b")] + rows[:9]
    df = spark.createDataFrame([(i, t, lang, s, "clash", 1) for i, (lang, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n long").repartition(5)
    for pairs, tallies in ((D.PAIRS, D.TALLIES), (7, 5)):
        monkeypatch.setattr(D, "PAIRS", pairs)
        monkeypatch.setattr(D, "TALLIES", tallies)
        got = [tuple(r) for r in D.audit(df, 5, 5, 3).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_audit(rows, 5, 3)
    assert {r[4] for r in got if r[0] == "xx"} == {0}
    assert D.audit(empty).count() == 0
    nothing = D.audit(empty.unionByName(spark.createDataFrame([(1,)], "doc_id long"), allowMissingColumns=True).unionByName(spark.createDataFrame([(1, "b")], "doc_id long, source string"), allowMissingColumns=True))
    assert sorted(map(tuple, nothing.collect())) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


def test_counts_beyond_a_long_stay_exact(spark):
    df = spark.createDataFrame([(10**15, 10**16, 3)], "c long, n long, v long")
    assert df.select(D.share(F.col("c"), F.col("n"), F.col("v"), 5)).first()[0] == 1 + 10**9 * (10**15 + 5) // (10**16 + 15)


def test_features_of_a_long_text_in_slices(monkeypatch):
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(4000)}" for _ in range(30_000))
    whole = toxicity.features([text, "short one"])
    monkeypatch.setattr(toxicity, "SLICE", 9000)
    assert all(np.array_equal(a, b) for a, b in zip(whole, toxicity.features([text, "short one"]), strict=True))
    assert [len(x) for x in toxicity.features(["", "one", "one two", "one one", "." * 50])] == [0, 1, 3, 2, 0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = language_id.held_out(5, 0)
    model = toxicity.fit(docs.where(~held), labels.where(~held))
    assert 0 < len(model.places) < 20_000
    rows = toxicity.score(docs, model).join(labels.where(held), "doc_id").collect()
    s, y = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    order = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert order > 0.85 and ((s >= 0.5) & (y == 0)).sum() <= 0.03 * (y == 0).sum()
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_toxicity_on_odd_tables(spark, docs, empty):
    bad = [(i, f"clean words {i} idiot scum here" if i % 2 else f"clean words {i} are good here") for i in range(1000, 1200)]
    more = spark.createDataFrame(bad, "doc_id long, text string")
    rows = docs.select("doc_id", "text", "held_out").unionByName(more, allowMissingColumns=True)
    labels = more.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic").union(spark.createDataFrame([(1, 1), (None, 1), (77777, 0), (4, None)], "doc_id long, toxic int"))
    model = toxicity.fit(rows, labels)
    got = {r["doc_id"]: r for r in toxicity.score(rows, model, "held_out").collect()}
    assert all(got[i]["predicted"] == i % 2 for i in range(1000, 1200))
    assert got[1]["score"] == got[2]["score"] == 1 / (1 + np.exp(-model.bias)) and all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(rows, labels.limit(0)).score(["x"])[0] == 0.0
    assert toxicity.fit(rows, labels.where("toxic = 1")).score(["x"])[0] == 1.0
    assert toxicity.fit(empty, labels).score(["x"])[0] == 0.0
