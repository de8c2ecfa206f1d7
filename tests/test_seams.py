"""Contracts of plug-ins, and the smaller review operators."""

import json

import pytest
from pyspark.sql import functions as F

from sightline.operators import cascade as C
from sightline.operators import review as R
from sightline.operators import seams as S
from sightline.plans.base import shared_folder
from sightline.sources import writers


@pytest.fixture
def embedder():
    @S.register("embedder", "ones")
    def ones(rows):
        return rows.select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"), F.lit("more").alias("more"))

    yield S.get("embedder", "ones")
    S.remove("embedder", "ones")


def test_contracts(spark, embedder):
    rows = spark.createDataFrame([(1, b"x")], "id int, content binary")
    got = embedder(rows)
    assert got.dtypes == [("id", "int"), ("embedding", "array<float>")]
    assert S.unit_length(got).count() == 1
    with pytest.raises(S.BrokenSeam, match="is given: column content is missing"):
        embedder(rows.drop("content"))
    with pytest.raises(S.BrokenSeam, match="column content is string, not binary"):
        embedder(rows.withColumn("content", F.lit("x")))
    bad = {"column score is missing": lambda r: r.select("id", F.lit("b").alias("brand")), "column score is string": lambda r: r.select("id", F.lit("b").alias("brand"), F.lit("1").alias("score")), "a DataFrame is wanted, not list": lambda r: r.collect()}
    for says, run in bad.items():
        with pytest.raises(S.BrokenSeam, match=says):
            S.checked("technique", "t", run)(rows)
    with pytest.raises(S.BrokenSeam, match="there already"):
        S.register("embedder", "ones")(None)
    with pytest.raises(S.BrokenSeam, match="no detector x"):
        S.get("detector", "x")
    with pytest.raises(S.BrokenSeam, match="no kind"):
        S.register("painter", "x")
    with pytest.raises(Exception, match="unit vectors"):
        S.unit_length(got.withColumn("embedding", F.array(F.lit(2.0).cast("float")))).collect()
    more = spark.createDataFrame([(1, "b", 1.0), (2, "b", 1.0)], S.contract_ddl("technique").simpleString()[7:-1].replace(":", " ").replace("id string", "id int"))
    assert [r["id"] for r in S.strangers(rows, more, "technique").collect()] == [2]


def test_chain_names_the_technique_that_breaks_it(spark):
    rows = spark.createDataFrame([(1,)], "id int")
    with pytest.raises(S.BrokenSeam, match="technique bad gives no score"):
        C.first_match(rows, [("bad", lambda r: r.select("id", F.lit("b").alias("brand")))])


def test_known_tab(spark):
    k = spark.createDataFrame([("a", "x", "Correct", "FP "), ("b", "x", "Incorrect", None), ("c", "y", "Correct", "Wrong_Logo"), ("d", "x", "Correct", "")], "filepath string, brand string, verdict string, correction string")
    reviews = spark.createDataFrame([("a", "done"), ("c", "open"), ("c", "done")], "filepath string, status string")
    names = lambda df: sorted(r["filepath"] for r in df.collect())
    assert names(R.known_tab(k)) == ["a", "b", "c", "d"]
    assert names(R.known_tab(k, brand="x", verdict="Correct")) == ["a", "d"]
    assert names(R.known_tab(k, status="", reviews=reviews)) == ["b", "d"]
    assert names(R.known_tab(k, status="open", reviews=reviews)) == ["c"]
    assert names(R.without_false_positives(k)) == ["b", "c", "d"]
    with pytest.raises(ValueError, match="without reviews"):
        R.known_tab(k, status="")


def test_pairs_by_stem(spark):
    images = spark.createDataFrame([("i/a.jpg",), ("i/b.c.png",), ("i/none.png",), (".hidden",)], "path string")
    labels = spark.createDataFrame([("l/a.txt",), ("m/a.txt",), ("l/b.c.txt",), ("l/other.txt",)], "path string")
    pairs, counts = R.pair_by_stem(images, labels)
    assert sorted(map(tuple, pairs.collect())) == [("i/a.jpg", "l/a.txt", "a"), ("i/b.c.png", "l/b.c.txt", "b.c")]
    assert tuple(counts.first()) == (4, 2, 2)
    assert tuple(R.pair_by_stem(images.limit(0), labels)[1].first()) == (0, 0, 0)


def test_canonical_map(spark, tmp_path):
    m = spark.createDataFrame([("coke", "Coca-Cola"), (" coke", "Cola"), ("é\"", "É"), ("x", " "), (None, "y"), ("", "z")], "brand string, brand_canonical string")
    got = writers.canonical_map_json(m, f"file://{tmp_path}/m").first()["value"]
    assert json.loads(got) == {"coke": "Coca-Cola", "é\"": "É"} and list(json.loads(got)) == ["coke", "é\""]
    assert spark.read.text(f"file://{tmp_path}/m").first()["value"] == got


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session)
