"""Small cases worked out by hand, one for each rule that is easy to get wrong."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import geometry as G
from sightline.functions import images as I
from sightline.functions import similarity as S
from sightline.functions import text as T
from sightline.operators import boxes as B
from sightline.operators import cascade as C
from sightline.operators import matching as M
from sightline.operators import retrieval as R
from sightline.operators import review as V
from sightline.operators import timeline as L
from sightline.operators import vectors as X
from sightline.sources import readers, writers
from sightline.sources.store import Store
from sightline.streaming import presence


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lit(*values):
    return [F.lit(v) for v in values]


def test_similarity_scale(spark):
    r = one(spark, *(f(F.lit(d)).alias(f"{f.__name__}{i}") for i, d in enumerate((0.0, 2.0, 4.0)) for f in (X.similarity, X.cosine)))
    assert list(r) == [1.0, 1.0, 0.5, 0.0, 0.0, -1.0]


@pytest.fixture
def gallery(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], f"b{i % 5}") for i in range(120)] + [(200 + i, [1.0] * 8, "same") for i in range(4)] + [(300, [9.0] * 8, "lonely"), (301, None, "b1")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, brand string")


def test_knn_ways_agree(spark, gallery, monkeypatch):
    q = gallery.where("vec_id % 3 = 0 and embedding is not null").select(F.col("vec_id").alias("query_id"), "embedding")
    g = gallery.where("embedding is not null")
    key = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["d2"], 9)) for r in df.collect())
    want = key(X.knn_expressions(q, g, 4, True))
    assert key(X.knn(q, gallery, 4, True)) == want
    monkeypatch.setattr(X, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(X, "BLOCK", 1)
    assert key(X.knn(q, gallery, 4, True)) == want
    assert X.knn(q, g.limit(0), 3).count() == 0


def test_leave_one_out_skips_single(spark, gallery):
    hits = R.leave_one_out(gallery.where("embedding is not null"))
    asked = {r["query_id"] for r in hits.select("query_id").collect()}
    assert 300 not in asked and 200 in asked
    assert 300 in {r["vec_id"] for r in R.leave_one_out(gallery.where("embedding is not null"), 200).collect()}


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, rank int, brand string, true_brand string, similarity double")


def test_sweep_and_misses(spark):
    h = hits(spark, [(1, 1, "B", "A", 0.9), (1, 2, "A", "A", 0.6), (2, 1, "C", "D", 0.4)])
    s = R.summary(h).first()
    assert (s["recall_at_1"], s["recall_at_3"], s["mrr"]) == (0.0, 0.5, 0.25)
    at = {r["threshold"]: r for r in R.sweep(h, [0.5, 0.7, 0.95]).collect()}
    assert (at[0.7]["recall_at_1"], at[0.7]["mrr"], at[0.7]["coverage"]) == (0.0, 0.0, 0.5)
    assert at[0.5]["mrr"] == 0.25 and at[0.95]["coverage"] == 0.0
    assert R.summary(h.limit(0)).first()["mrr"] == 0.0


def test_consensus_tie(spark):
    rows = [(1, k + 1, b, None, 1.0) for k, b in enumerate("ABBAC")]
    r = X.consensus(hits(spark, rows)).first()
    assert (r["winner"], r["votes"], r["share"]) == ("a", 2, 0.4)


def test_gates(spark):
    def gate(*v):
        return tuple(one(spark, *(c.alias(n) for n, c in C.gallery_gates(*(F.lit(x) for x in v)).items())))

    assert gate("false_logo", 0.98, None, 0, 0.0, "x", None, 0.0) == ("UNKNOWN", 0.0, "false_logo")
    assert gate("Rai Sport", 0.92, "Rai Sport", 4, 0.8, "", None, 0.0) == ("rai sport", 0.92, "consensus")
    assert gate("A", 0.97, "B", 1, 0.2, "", None, 0.0)[:2] == ("A", 0.97)
    assert gate("A", 0.9, "B", 4, 0.8, "ab", "A", 99.0)[2] == "short_text"
    assert gate("A", 0.9, "B", 4, 0.8, "abc", "A", 80.0) == ("A", 0.8, "text")
    assert gate(None, None, None, None, None, "abc", None, None)[2] == "no_hit"


def test_verdicts(spark):
    assert list(one(spark, *(T.verdict(F.lit(v)).alias(f"v{i}") for i, v in enumerate(["Incorrect", "correct", "Other/Correct", "", None])))) == ["Incorrect", "Correct", "Other", "Incorrect", "Incorrect"]


def test_postfilter_skips(spark):
    rows = spark.createDataFrame([(1, "A", "database"), (2, "B", "database"), (3, "C", "manual")], "logo_id long, brand string, source string")
    verdicts = spark.createDataFrame([(1, "correct"), (2, "nonsense"), (3, "incorrect")], "logo_id long, raw string")
    got = {r["logo_id"]: (r["brand"], r["postfilter_verdict"], r["kept"]) for r in C.postfilter(rows, verdicts, ["database"], "llm").collect()}
    assert got == {1: ("A", "Correct", True), 2: ("UNKNOWN", "Incorrect", False), 3: ("C", "Skipped", True)}


def test_chain_runs_on_what_is_left(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    seen = []

    def technique(name, take):
        def run(df):
            seen.append((name, sorted(r["id"] for r in df.collect())))
            return df.select("id", F.when(F.col("id") == take, name).alias("brand"), F.lit(1.0).alias("score"))

        return name, run

    got = {r["id"]: (r["brand"], r["technique"]) for r in C.first_match(items, [technique("a", 2), technique("b", 1)]).collect()}
    assert got == {1: ("b", "b"), 2: ("a", "a"), 3: ("UNKNOWN", None)}
    assert seen == [("a", [1, 2, 3]), ("b", [1, 3])]


def test_yes_no(spark):
    a = spark.createDataFrame([(1, "I know it"), (1, "Yes"), (2, "maybe"), (3, None)], "k long, t string")
    got = {r["k"]: (r["include"], r["probability"]) for r in C.yes_no(a, "k", "t").collect()}
    assert got == {1: (2, 0.5), 2: (0, None), 3: (0, None)}
    assert {r["k"]: r["include"] for r in C.yes_no(a, "k", "t", True).collect()}[1] == 1


def test_routes(spark):
    r = lambda *v: one(spark, C.route(*lit(*v)).alias("r"))["r"]
    assert r(0.8, 0.8, 0.9, 0.0, True, False, False) == "LLM"
    assert r(0.9, 0.5, 0.1, 0.9, True, False, False) == "EXCLUDE"
    assert r(0.1, 0.0, 0.1, 0.4, False, True, False) == "API"


def test_intervals_repeat_sources(spark):
    d = spark.createDataFrame([("v", "x", 3, 0, 3.0, "b"), ("v", "x", 1, 0, 1.0, "a"), ("v", "x", 2, 0, 2.0, "b"), ("v", "UNKNOWN", 0, 0, 0.0, "c")], "video string, brand string, frame int, tie int, time double, source string")
    r = L.brand_intervals(d, ["video", "brand"]).collect()
    assert [(x["brand"], x["start"], x["stop"], x["source"]) for x in r] == [("x", 1.0, 3.0, "a, b, b")]
    same = d.where("frame = 3").union(d.where("frame = 3").withColumn("frame", F.lit(4)))
    assert L.brand_intervals(same, ["video", "brand"]).first()["source"] == "b"


def test_peaks_and_keyframes(spark):
    v = [1.0] * 30
    v[10] = v[20] = 9.0
    v[0] = v[29] = 50.0
    s = spark.createDataFrame([("v", i, x, 2.0) for i, x in enumerate(v)], "video string, frame int, ratio double, threshold double")
    p = L.peaks(s, ["video"], ["frame"], "ratio")
    assert sorted(r["pos"] for r in p.collect()) == [10, 20]
    assert sorted(r["keyframe"] for r in L.keyframes(p, ["video"]).collect()) == [5, 15]


def test_sampling(spark):
    r = one(spark, L.segment_middles(F.lit(10), 4).alias("a"), L.every_interval(F.lit(10), F.lit(1.25)).alias("b"), L.every_interval(F.lit(0), F.lit(1.0)).alias("c"), L.nearest_offsets(F.array(*lit(-2, -1, 1, 2)), F.array(*lit(5, -5))).alias("d"), L.expand(F.lit(1), F.lit(5), 2).alias("e"))
    assert list(r) == [[1, 5, 8], [0, 2, 4, 6, 8], [], [-5, 5], [0, 1, 2, 3]]
    c = one(spark, L.context(F.lit(0), F.lit(3), 1).alias("c"))["c"]
    assert [(x["offset"], x["frame"]) for x in c] == [("-1", None), ("+1", 1)]


def test_boxes(spark):
    crop = lambda *b: tuple(one(spark, *(c.alias(n) for n, c in G.crop(*lit(*b)).items())))
    assert crop(0.0, 0.0, 15.0, 40.0)[-1] is False and crop(0.0, 0.0, 16.0, 16.0)[-1] is True
    assert crop(2.5, 3.5, 40.0, 40.0)[:2] == (2, 4)
    grown = one(spark, *(c.alias(n) for n, c in G.enlarge(*lit(0.0, 0.0, 10.0, 10.0), 1.5, *lit(12, 12)).items()))
    assert list(grown) == [0.0, 0.0, 12.0, 12.0]
    assert list(one(spark, *(G.passes_area(*lit(*s)).alias(f"c{i}") for i, s in enumerate([(20, 24), (20, 25), (100, 20)])))) == [False, True, False]
    assert one(spark, G.touches_edge(F.lit(None).cast("int"), *lit(1, 2, 3, 4, 5)).alias("t"))["t"] is False


def test_clamp_score(spark):
    values = ["87.9", "140", "-3", "x", None, "nan", "inf"]
    assert list(one(spark, *(G.clamp_score(F.lit(v).cast("string")).alias(f"c{i}") for i, v in enumerate(values)))) == [87, 100, 0, None, None, None, None]


def test_gate_of_ten(spark):
    b = spark.createDataFrame([(f, i, 5.0 if i == 0 else 50.0) for f, n in ((1, 9), (2, 10)) for i in range(n)], "frame int, i int, side double")
    got = L.busy_gate(b, ["frame"], G.passes_area(F.col("side"), F.col("side")))
    assert {(r["frame"], r["n"]) for r in got.groupBy("frame").agg(F.count("*").alias("n")).collect()} == {(1, 9), (2, 9)}


def test_signals(spark):
    f = lambda items, compat=False: one(spark, T.canonical_signals(F.array(*lit(*items)), compat).alias("s"))["s"]
    assert f(["OCR", "database", "ocr"]) == ["ocr_text", "faiss_matches"]
    assert f(["!!!"]) == [] and f(["!!!"], True) == ["tight_crop"]
    assert f(["my full_frame view", "none"]) == ["full_frame"]


def test_json(spark):
    assert one(spark, F.from_json(T.outer_json(F.lit('x {"a":1} y {"b":2}')), "a int")["a"].alias("a"))["a"] is None
    assert one(spark, T.outer_json(F.lit("none")).alias("a"))["a"] is None
    b = lambda t: tuple(one(spark, M.box_1000(F.lit(t), *lit(1000, 1000)).alias("b"))["b"])
    assert b('{"bbox_2d": [100, 200, 300, 400]}') == (100, 200, 300, 400)
    assert b("at [100, 200, 300, 400]") == (200, 100, 400, 300)


def test_review_metrics(spark):
    rows = spark.createDataFrame([("TP",), ("TP",), ("FP",), ("FN",), ("wrong_brand",), ("",), (None,)], "label string")
    a, b = V.review_metrics(rows).first(), V.review_metrics(rows, True).first()
    assert (round(a["precision"], 3), round(a["recall"], 3), round(a["f1"], 3), a["labelled"]) == (0.667, 0.667, 0.667, 5)
    assert b["precision"] == 0.5
    assert V.review_metrics(rows.limit(0)).first()["f1"] == 0.0


def test_null_confidence_counts_as_50(spark):
    rows = spark.createDataFrame([(None, "logo", None)], "confidence int, is_logo string, label string")
    assert V.review_filter(rows, [], [], False, 60, 100).count() == 0
    assert V.review_filter(rows, [], [], False, 40, 100).count() == 1
    assert V.review_filter(rows, [], ["TP"], False, 0, 100).count() == 0


def test_brand_seen_in_misses_only(spark):
    known = spark.createDataFrame([], "brand string, filepath string, correction string")
    r = V.brand_breakdown(known, spark.createDataFrame([("x ",)], "brand string")).first()
    assert (r["brand"], r["total_images"], r["false_negatives"]) == ("x", 0, 1)
    assert V.brand_overview(known, spark.createDataFrame([("x",)], "brand string")).first()["not_reviewed"] == 1


def test_scores():
    assert S.ratio("abcd", "abd") == pytest.approx(600 / 7)
    assert S.partial_ratio("nike", "the nike shop") == 100
    assert S.jaro_winkler("verisure", "verishure") == pytest.approx(0.9777777777777777)
    assert S.token_set_ratio("a b", "b a c") == 100
    for f in S.SCORERS.values():
        assert f("river", "river") in (1.0, 100.0) and f("ab", "xy") <= 50
    rng = random.Random(0)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(9))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert S.lcs(a, b) == t[-1][-1]
        assert S.ratio(a, b) == S.ratio(b, a) and 0 <= S.wratio(a, b) <= 100


def test_best_match_ways_agree(spark, monkeypatch):
    rng = random.Random(2)
    name = lambda: "".join(rng.choice("abcd ") for _ in range(8)).strip()
    q, b = sorted({name() for _ in range(20)}), sorted({name() for _ in range(30)})
    qs, bs = spark.createDataFrame([(x,) for x in q], "q string"), spark.createDataFrame([(x,) for x in b], "b string")
    want = {x: max(b, key=lambda y: (S.wratio(x, y), [-ord(c) for c in y])) for x in q}
    best = {x: max(S.wratio(x, y) for y in b) for x in q}
    for most in (10**6, 1):
        monkeypatch.setattr(M, "MOST_BYTES", most)
        monkeypatch.setattr(M, "BLOCK", 7)
        got = {r["q"]: (r["b"], r["score"]) for r in M.best_match(qs, "q", bs, "b", "wratio", 0.0).collect()}
        assert {k: v[1] for k, v in got.items()} == best
        assert all(S.wratio(k, v[0]) == best[k] for k, v in got.items()) and set(got) == set(want)


def test_short_text_needs_more(spark):
    q, b = spark.createDataFrame([("abc",)], "q string"), spark.createDataFrame([("abcd",)], "b string")
    assert M.best_match(q, "q", b, "b", "ratio", 70.0).first()["b"] == "abcd"
    limit = S.ratio("abc", "abcd") - 15
    assert M.best_match(q, "q", b, "b", "ratio", limit).first()["b"] == "abcd"
    assert M.best_match(q, "q", b, "b", "ratio", limit, strict=True).first()["b"] is None


def brute_nms(rows, limit):
    stay = []
    for r in sorted(rows, key=lambda r: (-r[5], r[6])):
        for s in stay:
            w, h = min(r[3], s[3]) - max(r[1], s[1]), min(r[4], s[4]) - max(r[2], s[2])
            if w > 0 and h > 0 and w * h > limit * ((r[3] - r[1]) * (r[4] - r[2]) + (s[3] - s[1]) * (s[4] - s[2]) - w * h):
                break
        else:
            stay.append(r)
    return stay


def test_nms(spark):
    rng = random.Random(4)
    rows = []
    for f in range(40):
        for k in range(rng.randrange(1, 12)):
            x, y = rng.random() * 20, rng.random() * 20
            rows.append((f, x, y, x + 5 + rng.random() * 10, y + 5 + rng.random() * 10, round(rng.random(), 1), k))
    df = spark.createDataFrame(rows, "frame int, x1 double, y1 double, x2 double, y2 double, score double, k int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted((r["frame"], r["k"]) for r in B.nms(df, ["frame"], ["k"], 0.3).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted((r[0], r[6]) for f in range(40) for r in brute_nms([x for x in rows if x[0] == f], 0.3))


def test_cluster_filter_drops_the_low(spark):
    rng = random.Random(5)
    rows = [(i, c * 10 + rng.random(), c * 5 + rng.random(), 1.0, float(c)) for c in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, a double, b double, flat double, score double")
    assert {r["score"] for r in B.cluster_filter(df, ["a", "b", "flat", "score"], "score").collect()} == {1.0, 2.0}


def test_images(spark):
    flat, stripes = bytes([7] * 256), bytes([0, 0, 0, 0, 255, 255, 255, 255] * 32)
    df = spark.createDataFrame([("flat", flat), ("stripes", stripes), ("none", None), ("short", b"1")], "name string, data binary")
    size = (F.lit(16), F.lit(16), F.lit(1))
    got = {r["name"]: list(r)[1:] for r in df.select("name", I.texture("data", *size), I.edge_share("data", *size), I.colour_spread("data", *size)).collect()}
    assert got["flat"] == [0.0, 0.0, 0.0] and got["none"] == got["short"] == [None] * 3
    assert got["stripes"][0] == pytest.approx(127.5) and got["stripes"][1] > 0.05
    assert I.edges(np.zeros((3, 3))).sum() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Company,x\nAcme,1\nBeta,2\n")
    (tmp_path / "b.csv").write_text("Brand\nBeta\nGamma\n")
    paths = [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"]
    assert [r["brand"] for r in readers.brand_lists(spark, paths).orderBy("list", "place").collect()] == ["Acme", "Beta", "Gamma"]
    with pytest.raises(ValueError, match="filename"):
        readers.csv(spark, paths[0], ["filename"])
    assert readers.csv(spark, paths[0], [], {"x": "int", "label": "string"}).first()["x"] == 1
    det = {"det_id": 1, "frame_idx": 3, "box_xyxy": [1.0, 2.0, 3.0, 4.0], "temporal_frames": {"+1": "a.png", "-1": None}}
    (tmp_path / "m.json").write_text(json.dumps({"video": "v", "fps": 25.0, "total_frames": 9, "detections": [det]}, indent=1))
    r = readers.manifest(spark, f"{tmp_path}/m.json").first()
    assert (r["video"], r["det_id"], r["box_xyxy"], r["temporal_frames"]) == ("v", 1, [1.0, 2.0, 3.0, 4.0], {"+1": "a.png", "-1": None})
    (tmp_path / "n.json").write_text(json.dumps({"box": [{"labels": ["A"], "sequence": [{"frame": 1, "time": 0.1, "x": 5, "y": 6, "width": 7, "height": 8, "enabled": False}]}]}))
    assert readers.annotations(spark, f"{tmp_path}/n.json").first()["label"] == "A"
    for brand in ("acme", "beta"):
        (tmp_path / "img" / brand).mkdir(parents=True)
        (tmp_path / "img" / brand / "1.png").write_bytes(b"x")
    (tmp_path / "img" / "note.txt").write_text("no")
    assert sorted(r["brand"] for r in readers.image_files(spark, f"{tmp_path}/img", True).collect()) == ["acme", "beta"]
    (tmp_path / "l.txt").write_text("1 0.1 0.2 0.3 0.4\n9 0 0 0 0\nx\n")
    assert sorted(r["valid"] for r in readers.label_lines(spark, f"{tmp_path}/l.txt", 3).collect()) == [False, False, True]
    spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/g")
    assert readers.gallery(spark, f"{tmp_path}/g", 2).count() == 1
    with pytest.raises(Exception, match="embedding length"):
        readers.gallery(spark, f"{tmp_path}/g", 3).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], "A"), (2, None, "UNKNOWN"), (3, [], None)], "id long, tags array<string>, brand string")
    writers.to_csv(df, f"{tmp_path}/c")
    assert {r["id"]: r["tags"] for r in readers.csv(spark, f"{tmp_path}/c").collect()} == {"1": '["a","b"]', "2": None, "3": "[]"}
    writers.split_known(df, f"{tmp_path}/k")
    assert spark.read.parquet(f"{tmp_path}/k").where("is_known = 'true'").count() == 1
    assert writers.append_new(df, f"{tmp_path}/a", ["id"]).count() == 3
    assert writers.append_new(df.union(df), f"{tmp_path}/a", ["id"]).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    rows = [("v", "x", f"2024-01-01 00:{m:02d}:00", 0.5) for m in (0, 5, 30, 31)] + [("v", "UNKNOWN", "2024-01-01 00:01:00", 0.1), ("v", "y", "2024-01-01 03:00:00", 0.2)]
    df = spark.createDataFrame(rows, "video string, brand string, ts string, score double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = presence.sessions(stream).writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    want = sorted(map(tuple, presence.sessions(df).where("brand = 'x'").collect()))
    assert sorted(map(tuple, spark.sql("select * from seen where brand = 'x'").collect())) == want and len(want) == 2
    vectors = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):
        presence.grow_gallery(vectors.select("brand", "score"), f"{tmp_path}/gallery", f"{tmp_path}/cp2", ["brand"]).awaitTermination()
    assert Store(spark, f"{tmp_path}/gallery").read().count() == 3


def test_words_are_told_by_any_white_space():
    assert S.smart_score("coca\tcola", "cola\ncoca") == S.smart_score("coca cola", "cola coca") == 95.0


def test_suppression_without_a_frame(spark, monkeypatch):
    """Rows without a frame are one group, also across batches."""
    rows = [(None, i, 0.0, 0.0, 10.0, 10.0, 1.0 - i / 100) for i in range(40)]
    df = spark.createDataFrame(rows, "frame long, id long, x1 double, y1 double, x2 double, y2 double, score double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert [r["id"] for r in B.nms(df, ["frame"], ["id"], 0.5).collect()] == [0]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
