"""The language stage: what it lets through, with and without a model."""

import os

import pytest

from sightline.llm import language_id

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
FOREIGN = ["日本語の文章です。これは日本語です。", "привет мир это русский текст и ещё немного", "ahoj jak se dnes máš kamaráde, dobře děkuji že se ptáš", "Hyvää päivää, mitä kuuluu tänään ystäväni", "123 456", "", None]


def test_without_a_model_lettered_texts_stay(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, None, None), (3, "12 !!", None), (4, "日本語", None)], "doc_id long, text string, lang string")
    assert language_id.fit(docs) is None
    assert {r["doc_id"] for r in language_id.accept(docs, None).collect()} == {1, 4}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_known_languages_stay_and_others_go(spark):
    """No document of the standard table is lost; texts in other languages, which no label names, are."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out(3, 1)))
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(FOREIGN)], "doc_id long, text string")
    kept = language_id.accept(docs.unionByName(more, allowMissingColumns=True), model).select("doc_id")
    want = docs.where(docs["text"].rlike(r"\p{L}")).select("doc_id")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in want.collect())
