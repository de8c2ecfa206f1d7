"""Batch matching, evidence, and the readers and writers that go with them."""

import json

import pytest
from pyspark.sql import functions as F

from sightline.functions import similarity as S
from sightline.functions import text as T
from sightline.operators import cascade as C
from sightline.operators import evidence as E
from sightline.operators import matching as M
from sightline.operators import timeline as L
from sightline.sources import readers, writers


def test_batch_match(spark):
    q = spark.createDataFrame([("  NIKE ",), ("zzzz",), ("ab",), (None,)], "q string")
    b = spark.createDataFrame([("nike", 3), ("adidas", 1), ("nikf", 2)], "b string, place int")
    got = {r["q"]: (r["b"], r["score"]) for r in M.best_match_batch(q, "q", b, "b", "place", 70.0).collect()}
    assert got == {"  NIKE ": ("nike", 100.0), "zzzz": ("UNKNOWN", 0.0), "ab": ("UNKNOWN", 0.0)}
    with pytest.raises(ValueError):
        M.best_match_batch(q, "q", b.where("b is null"), "b", "place")


@pytest.mark.parametrize("most", [10**6, 1])
def test_ties_by_the_list(spark, monkeypatch, most):
    monkeypatch.setattr(M, "MOST_BYTES", most)
    monkeypatch.setattr(M, "BLOCK", 1)
    q = spark.createDataFrame([("abc1",)], "q string")
    b = spark.createDataFrame([("abc2", 10), ("abc3", 9)], "b string, place int")
    assert S.ratio("abc1", "abc2") == S.ratio("abc1", "abc3")
    assert M.best_match(q, "q", b, "b", "ratio", 0.0, place="place").first()["b"] == "abc3"
    assert M.best_match(q, "q", b, "b", "ratio", 0.0).first()["b"] == "abc2"


def test_limit_itself_is_not_enough_in_batches(spark):
    q, b = spark.createDataFrame([("nike",)], "q string"), spark.createDataFrame([("nike", 0)], "b string, place int")
    r = M.best_match_batch(q, "q", b, "b", "place", 100.0).first()
    assert (r["b"], r["score"]) == ("UNKNOWN", 100.0)


def test_audio_technique(spark):
    i = spark.createDataFrame([(1, "Nike"), (2, "ni"), (3, None), (4, "nike")], "id int, ocr string")
    b = spark.createDataFrame([(" NIKE", 0)], "b string, place int")
    one = {r["id"]: (r["b"], r["source"]) for r in M.audio_technique(i, "id", "ocr", b, "b", "place").withColumnRenamed("brand", "b").collect()}
    assert {k: v[0] for k, v in one.items()} == {1: "nike", 2: "UNKNOWN", 3: "UNKNOWN", 4: "nike"} and one[4][1] == "audio"
    many = {r["id"]: r["brand"] for r in M.audio_technique(i, "id", "ocr", b, "b", "place", batch=True).collect()}
    assert many == {1: "nike", 2: "UNKNOWN", 3: "UNKNOWN", 4: "nike"}


def test_enabled_signals():
    assert E.enabled_signals() == T.SIGNALS
    assert E.enabled_signals(["ocr_text", "tight_crop"]) == ["tight_crop", "ocr_text"]
    with pytest.raises(ValueError, match="smell"):
        E.enabled_signals(["smell"])


def test_canonical_map(spark):
    r = spark.range(1).select(E.canonical_map(F.lit('x {"a": " b ", "c": " "} y')).alias("m"), E.canonical_map(F.lit("none")).alias("n")).first()
    assert r["m"] == {"a": "b"} and r["n"] is None
    rows = spark.createDataFrame([("a",), ("c",), ("UNKNOWN",), (None,)], "b string").select(E.canonical_brand(F.col("b"), E.canonical_map(F.lit('{"a": "b", "UNKNOWN": "x"}'))))
    assert [r[0] for r in rows.collect()] == ["b", "c", "UNKNOWN", None]


def test_open_rule_and_parts(spark):
    r = spark.range(1).select(E.brand_rule(F.array(), False).alias("open"), T.after_first(F.lit("a ASSISTANT: b ASSISTANT: c"), "ASSISTANT:").alias("tail"), T.after_first(F.lit("a"), "x").alias("no"), T.header_line(F.lit("none"), "H").alias("h"), T.remap(F.lit("/a.b/c"), "/a.b", "/x").alias("p")).first()
    assert "UNKNOWN" in r["open"] and list(r)[1:] == ["b", None, None, "/x/c"]


def test_frames_stay_when_all_results_go(spark):
    rows = spark.createDataFrame([("l1", 1, "database", "b")], "logo_id string, frame int, source string, brand string")
    frames = spark.createDataFrame([(1, 0.0), (2, 0.1)], "frame int, timestamp double")
    no = ("llm", ["database"], lambda asked: asked.select("logo_id", F.lit("incorrect").alias("raw")))
    out = C.postfilter_outputs(rows, frames, [no])
    assert {r["frame"]: len(r["results"]) for r in out["filtered_frames"].collect()} == {1: 0, 2: 0}
    assert out["filtered"].count() == 0 and out["annotated"].first()["brand"] == "UNKNOWN"
    assert {r["frame"]: [x["postfilter"]["verdict"] for x in r["results"]] for r in out["frames"].collect()} == {1: ["Incorrect"], 2: []}
    assert C.postfilters(rows, []).first()["postfilter_verdict"] == "Skipped"


def test_sources_with_commas(spark):
    d = spark.createDataFrame([("v", "x", i, 0, 1.0, s) for i, s in enumerate(("a", "a", "b", "a, b", "a, b, a, b"))], "video string, brand string, frame int, tie int, time double, source string")
    assert L.brand_intervals(d, ["video"]).first()["source"] == "a, b, a, b, a, b"


def test_more_readers(spark, tmp_path):
    for n, parsed in ((7, {"is_logo": "logo", "confidence": 90, "signals_used": ["ocr"]}), (8, None)):
        (tmp_path / f"det_{n}").mkdir()
        (tmp_path / f"det_{n}" / "prediction.json").write_text(json.dumps({"raw": "r", "parsed": parsed}))
    p = {r["det_id"]: (r["is_logo"], r["confidence"]) for r in readers.predictions(spark, f"{tmp_path}/det_*/prediction.json").collect()}
    assert p == {7: ("logo", "90"), 8: (None, None)}
    (tmp_path / "h.json").write_text(json.dumps({"det_id": 7, "faiss_top_k": [{"brand_name": "b", "similarity": 0.5}], "ocr": {"lines": [{"text": "t", "confidence": 0.9}], "source": "s"}}))
    h = readers.hints(spark, str(tmp_path / "h.json")).first()
    assert (h["det_id"], h["faiss_top_k"][0]["brand_name"], h["ocr"]["lines"][0]["text"]) == (7, "b", "t")
    (tmp_path / "s.csv").write_text("Frame Number,Timecode,adaptive_ratio (w=2),other\n1,00:00,,x\n2,00:01,1.5,y\n")
    assert [tuple(r) for r in readers.shot_stats(spark, str(tmp_path / "s.csv")).orderBy("frame").collect()] == [(1, "00:00", None), (2, "00:01", 1.5)]
    (tmp_path / "m.json").write_text(json.dumps([{"brand_name": "b"}, {"brand_name": "c"}]))
    assert readers.gallery_metadata(spark, str(tmp_path / "m.json")).count() == 2
    flat = tmp_path / "flat"
    (flat / "flat").mkdir(parents=True)
    for name in ("b.png", "a.JPG", "c.txt", "flat/d.png"):
        (flat / name).write_bytes(b"x")
    assert [r["name"] for r in readers.flat_folder(spark, str(flat)).collect()] == ["a.JPG", "b.png"]


def test_more_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, True), (2, False)], "id int, kept boolean")
    writers.verdicts_csv(rows, str(tmp_path / "v"))
    assert readers.csv(spark, f"{tmp_path}/v/with_verdicts").count() == 2 and readers.csv(spark, f"{tmp_path}/v/filtered").count() == 1
    o = writers.brand_object(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "brand string"), "audio_transcript", "m").first()
    assert (o["count"], o["brands"]) == (2, ["a", "b"])
    t = writers.comparison_table(spark.createDataFrame([("x", 0.5), ("long", 0.75)], "model string, recall_at_1 double"))
    assert t.split("\n") == ["model  recall_at_1", "-----  -----------", "long   0.7500", "x      0.5000"]
