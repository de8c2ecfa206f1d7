"""Language identification on the standard documents and on texts in other languages."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import language_id

SF = "/root/testdata/sf0.01"
#: Texts in none of the languages of the documents.
OTHERS = ["Съешь же ещё этих мягких французских булок да выпей чаю", "日本語のテキストはここにありますとても長い文章です", "Το ελληνικό κείμενο είναι εδώ και είναι μεγάλο", "xkcd qzj vvk zzx qqp wxk jjk zxz kqv"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_accuracy_and_the_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", language_id.held_out(3, 1))
    model = language_id.fit(docs.where(~F.col("held_out")))
    got = language_id.predict(docs, model, "held_out", "lang").where("held_out and lang is not null and lang_pred <> 'und'")
    n, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 100 and right >= 0.97 * n
    kept = language_id.accept(docs, model)
    assert kept.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    others = spark.createDataFrame([(i, t) for i, t in enumerate(OTHERS)], "doc_id long, text string")
    assert language_id.accept(others, model).count() == 0


def test_against_dense_kernel_ridge(spark):
    """Where all rows are landmarks, the predictions are those of kernel ridge regression by the whole kernel matrix."""
    rng = np.random.default_rng(4)
    words = {"a": ["stone", "river", "walk", "night"], "b": ["über", "nacht", "haus", "straße"]}
    texts = [(c, " ".join(rng.choice(words[c], 8)) + f" {chr(97 + i % 26)}{chr(97 + i % 7)}") for i in range(30) for c in "ab"]
    sets = [language_id.grams(t) for _, t in texts]
    model = language_id.KernelModel(sets, sets, [c for c, _ in texts], 0.05)
    x = np.array([[len(np.intersect1d(p, q)) / np.sqrt(len(p) * len(q)) for q in sets] for p in sets])
    assert np.abs(model.kernel(sets) - x).max() < 1e-5
    y = np.array([1.0 if c == "a" else -1.0 for c, _ in texts])
    weight = np.full(len(y), 1 / np.sqrt((y > 0).sum()))
    # With a bias feature: minimise the weighted squared loss + ridge * (norm in the kernel's space + bias squared).
    k = x + 1
    dense = k @ np.linalg.solve(np.diag(weight) @ k + 0.05 * np.eye(len(y)), weight * y)
    assert np.abs(model.values(sets)[:, 0] - dense).max() < 0.02


def test_repeated_rows_are_learned_once(spark):
    rows = [(1, "the stone and the river", "en")] * 500 + [(k, f"das haus und die straße {k}", "de") for k in range(2, 9)] + [(k, f"walk by night {k}", "en") for k in range(20, 26)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.fit(docs, sample=6)
    assert model.classes == ["de", "en"]
    few = language_id.fit(docs.dropDuplicates(), sample=6)
    assert np.allclose(model.marks, few.marks)
