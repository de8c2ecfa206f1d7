"""Each operator on odd rows against brute force or an exact round trip."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from near_brute import find, near_components, shingles
from tokenizers import Tokenizer

from sightline.llm import bpe, common, embedding_dedup, exact_dedup, language_id, minhash, packing, quality, substring_dedup, token_counts, token_files
from sightline.llm.common import components


@pytest.mark.parametrize("most", [20, 500_000])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(common, "TASK_EDGES", most)
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (4, 6), (10, 3)] + [(100, k) for k in range(101, 160)] + [(k, k + 1) for k in range(200, 240)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {9: 9} | {k: 1 for k in (1, 2, 3, 10)} | {4: 4, 5: 4, 6: 4} | {k: 100 for k in range(100, 160)} | {k: 200 for k in range(200, 241)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bpe(docs, texts):
    rows = {r["doc_id"]: r for r in bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken")).collect()}
    assert set(rows) == set(texts)
    for k, t in texts.items():
        assert rows[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert rows[1]["n_tokens"] == 0 and rows[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.encode(docs, P.path("byte_bpe_50k.tiktoken")).where("doc_id = 13").first()["ids"]


def test_exact(spark, docs, texts):
    twice = docs.union(docs.where("doc_id in (4, 13)"))
    groups = defaultdict(list)
    for k, t in [*texts.items(), (4, texts[4]), (13, texts[13])]:
        groups[t or ""].append(k)
    rows = exact_dedup.exact_groups(twice).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        g = groups[texts[r["doc_id"]] or ""]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(g), len(g), r["doc_id"] == max(g))
    kept = [r["doc_id"] for r in exact_dedup.drop_copies(twice).collect()]
    assert sorted(kept) == sorted(max(g) for g in groups.values())
    nameless = spark.createDataFrame([(None, "q"), (None, "q"), (3, "r"), (None, "r")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in exact_dedup.drop_copies(nameless).collect()) == [(0, "q"), (3, "r")]


@pytest.mark.parametrize("short", [1, 3])
def test_buckets_of_many_texts(spark, monkeypatch, short):
    """Texts that share length and short hash are told apart by their bytes; each row gets its own group's result."""
    monkeypatch.setattr(exact_dedup, "SHORT", short)
    monkeypatch.setattr(exact_dedup, "SPILL_BYTES", 4000)
    rng = np.random.default_rng(2)
    rows = [(int(i), "".join(rng.choice(list("abé"), rng.integers(0, 6)))) for i in rng.permutation(600)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in exact_dedup.exact_groups(df).collect()}
    assert got == {i: (max(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}


def test_trie_spills():
    rng = np.random.default_rng(1)
    rows = [(bytes(rng.integers(97, 100, rng.integers(0, 9))), int(i), 1) for i in range(3000)]
    want = {}
    for t, i, n in rows:
        a, b = want.get(t, (i, 0))
        want[t] = (max(a, i), b + n)
    for limit in (500, 1 << 30):
        assert {t: (i, n) for t, i, n in exact_dedup.owners(iter(rows), max, limit)} == want


def test_packing(docs, texts):
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {k: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for k, t in texts.items()}
    rows = packing.pack(docs, P.path("word_bpe_49k.json"), 2, size=256).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append(r)
    assert set(by) == set(texts)
    for k, parts in by.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[k])
            assert r["ids_crc32"] == zlib.crc32(ids[k][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[k])
    for parts in seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256 and at & (at - 1) == 0


def test_hilbert_neighbours_touch():
    side = np.arange(16)
    cells = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    key = packing.hilbert(cells, 4)
    assert sorted(key.tolist()) == list(range(4096))
    walk = cells[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 32])
def test_bit_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001)
    data = token_files.pack(ids, width)
    assert len(data) == -(-1001 * width // 8)
    assert token_files.unpack(data, width, 0, 1001).tolist() == ids.tolist()
    assert token_files.unpack(data, width, 333, 701).tolist() == ids[333:701].tolist()


def test_token_files(spark, docs, texts, tmp_path):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    path = f"file://{tmp_path}/ids"
    token_files.write(docs, path, P.path("byte_bpe_50k.json"), 0)
    rows = {r["doc_id"]: r for r in token_files.read(spark.read.parquet(path)).collect()}
    at = 0
    for k in sorted(texts):
        ids = np.array([*lib.encode(texts[k] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (rows[k]["start"], rows[k]["n_tokens"], rows[k]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    nameless = spark.createDataFrame([(None, "q"), (2**60, "r s"), (None, None)], "doc_id long, text string")
    got = token_files.round_trip(nameless, P.path("byte_bpe_50k.json"), 0).orderBy("start").collect()
    assert [(r["doc_id"], r["start"]) for r in got][2] == (2**60, 3) and got[0]["doc_id"] is None


def test_counts(docs, texts):
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in token_counts.count_tokens(docs, P.path("word_bpe_49k.json"), 2048).collect():
        t = texts[r["doc_id"]] or ""
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 2048)


def test_near(docs, texts):
    want = near_components(texts)
    rows = minhash.near_groups(docs.union(docs.where("doc_id = 6"))).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert r["n_shingles"] == len(shingles(texts[r["doc_id"]]))
        assert (r["component_id"], r["kept"]) == (want[r["doc_id"]], r["doc_id"] == want[r["doc_id"]])
    assert want[16] == 4 or texts[16] is None
    kept = {r["doc_id"] for r in minhash.drop_near_copies(docs).collect()}
    assert kept == {k for k, v in want.items() if k == v}


def test_near_crowd(spark):
    """A group whose pairs are near or not so near: buckets put pairs off, and no link is lost."""
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(120)]
    texts = {}
    for i in range(150):
        w = list(base)
        for k in rng.choice(120, rng.integers(0, 5), replace=False):
            w[k] = f"e{i}_{k}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = near_components(texts)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_groups(df).collect()} == want
    assert len(set(want.values())) > 1


def test_passages(docs, texts):
    rows = substring_dedup.repeated_passages(docs).collect()
    for r in rows:
        mine, own = texts[r["doc_id"]].encode(), texts[r["owner_id"]].encode()
        n = len(re.findall(rb"[^\x20\x09-\x0D]+", mine[r["start"] : r["stop"]]))
        assert r["owner_id"] < r["doc_id"] and n == r["n_words"] >= 50 and r["n_equal"] >= 0.8 * n and own[r["owner_start"] : r["owner_stop"]]
    found = {(r["doc_id"], r["owner_id"]) for r in rows}
    assert {(5, 4), (6, 4), (9, 8), (16, 4)} <= found
    assert not {r["doc_id"] for r in rows} & {1, 2, 3, 4, 8, 10, 11, 12, 13, 14}
    left = {r["doc_id"]: r for r in substring_dedup.remove_passages(docs).collect()}
    assert set(left) == set(texts) and left[5]["text"] == "" and left[8]["text"] == texts[8] and left[1]["text"] is None
    assert len(left[9]["text"].split()) <= 104 and left[9]["_cuts"] == "y"


def test_chains_ascend():
    at, own = np.array([0, 40, 80, 120, 5000]), np.array([1000, 1040, 200, 1120, 6000])
    best = substring_dedup.chains(at, own)[0]
    assert best.tolist() == [0, 1, 3]
    assert substring_dedup.stretches(np.array([True] * 60 + [False] * 30 + [True] * 55), 50, 0.8) == [(0, 60), (90, 145)]


def brute_links(vectors, limit):
    ok = {}
    for k, v in vectors:
        u = embedding_dedup.unit(v)
        if u is not None:
            ok[k] = u
    parent, links = {k: k for k, _ in vectors}, dict.fromkeys((k for k, _ in vectors), 0)
    for a in ok:
        for b in ok:
            if a < b and len(ok[a]) == len(ok[b]) and float(ok[a] @ ok[b]) >= limit:
                links[a] += 1
                links[b] += 1
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {k: (links[k], find(parent, k)) for k in parent}


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 1)
    rng = np.random.default_rng(2)
    v = [(i, rng.standard_normal(24).tolist()) for i in range(60)]
    for i in range(60, 120):
        b = np.array(v[i % 7][1])
        v.append((i, (b + rng.standard_normal(24) * rng.choice([0.0, 0.1, 0.25, 0.4])).tolist()))
    v += [(200, None), (201, []), (202, [0.0] * 24), (203, [float("nan")] * 24), (204, [float("inf")] + [0.0] * 23), (205, v[0][1][:5]), (206, [2 * x for x in v[1][1]]), (207, [None] + v[0][1][1:])]
    df = spark.createDataFrame([(k, x, 1, "c") for k, x in v], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    want = brute_links([(k, None if x is None or None in x else x) for k, x in v], 0.95)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_groups(df).collect()}
    assert got == want and max(n for n, _ in want.values()) > 3


def test_code_estimates_are_unbiased():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[0]
    codes, factor = embedding_dedup.encode(x[1:])
    estimate = embedding_dedup.signs(codes) @ embedding_dedup.rotate(q[None])[0] / factor
    error = estimate - x[1:] @ q
    assert abs(error.mean()) < 0.01 and error.std() < 0.15


def test_language(spark, empty):
    rng = np.random.default_rng(4)
    vocab = {"en": "the of and thing with over river stone".split(), "fr": "le une être château avec près voilà où".split(), "de": "der die und straße über nicht schön weiß".split()}
    rows = [(i, " ".join(rng.choice(vocab[lang], 30)), lang, None, None) for i, lang in enumerate(["en", "fr", "de"] * 40)]
    rows += [(900, None, "en", None, None), (901, "", None, None, None), (902, "12 !", "fr", None, None), (903, "over the river", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double").withColumn("held_out", language_id.held_out(3, 1))
    model = language_id.fit(df.where("not held_out"), sample=60, landmarks=30)
    got = {r["doc_id"]: r for r in language_id.predict(df.drop("lang_pred", "score"), model, "held_out").collect()}
    want = {r[0]: r[2] for r in rows[:120]}
    assert all(got[k]["lang_pred"] == v and 0 <= got[k]["score"] <= 1 for k, v in want.items())
    assert [got[k]["lang_pred"] for k in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    assert {r["doc_id"] for r in language_id.accept(df, model).collect()} == set(want) | {903}
    assert language_id.fit(empty) is None
    assert {r["lang_pred"] for r in language_id.predict(df.drop("lang_pred", "score"), None).collect()} == {"und"}


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(5)
    good = lambda: " ".join(rng.choice("the of and thing with over river stone".split(), 12)) + "."
    bad = lambda: "### ".join(rng.choice("THING$$$ %%% || && OVER!!".split(), 12))
    rows, labels = [], []
    for i in range(200):
        y = int(i % 4 != 0)
        lines = [good() if y or k == 0 else bad() for k in range(rng.integers(2, 8))]
        rows.append((i, "\n".join(lines)))
        labels.append((i, y if i % 9 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(df.where("doc_id < 150"), lab)
    got = {r["doc_id"]: r for r in quality.score(df, model).collect()}
    assert sum(got[i]["predicted"] == int(i % 4 != 0) for i in range(150, 200)) >= 48
    odd = quality.score(docs, model, "lang").collect()
    assert all(0 <= r["score"] <= 1 for r in odd) and len(odd) == docs.count()
    assert quality.score(empty, quality.fit(empty, lab)).count() == 0


def test_forward_backward():
    """Marginals of a chain against the sum over all labellings."""
    rng = np.random.default_rng(6)
    u, pair = rng.standard_normal(5), rng.standard_normal((2, 2))
    total, want = 0.0, np.zeros(5)
    for code in range(32):
        y = [(code >> k) & 1 for k in range(5)]
        p = np.exp(sum(u[k] * y[k] for k in range(5)) + sum(pair[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += p
        want += p * np.array(y)
    m, pairs = quality.chains(np.append(u, [0.3]), np.array([0] * 5 + [1]), pair)
    assert np.allclose(m[:5], want / total) and np.isclose(m[5], 1 / (1 + np.exp(-0.3))) and np.isclose(pairs.sum(), 4)


def test_empty_tables(spark, empty):
    word, byte = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
    for df in (
        bpe.round_trip(empty, P.path("byte_bpe_50k.tiktoken")),
        exact_dedup.exact_groups(empty),
        exact_dedup.drop_copies(empty),
        packing.pack(empty, word, 2),
        substring_dedup.repeated_passages(empty),
        substring_dedup.remove_passages(empty),
        token_files.round_trip(empty, byte, 0),
        minhash.near_groups(empty),
        token_counts.count_tokens(empty, word),
        embedding_dedup.near_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ):
        assert df.count() == 0
