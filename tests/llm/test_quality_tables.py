"""The quality classifier on the standard tables, and the bounds of its fit."""

import os

import numpy as np
import pytest

from sightline.llm import language_id, quality

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = language_id.held_out(5, 0)
    model = quality.fit(docs.where(~held), labels.where(~held))
    rows = quality.score(docs, model).join(labels.where(held), "doc_id").collect()
    s, y = np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows])
    order = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    wrong = np.mean([r["predicted"] != r["quality"] for r in rows])
    print("held out", len(rows), "area", round(order, 4), "wrong", round(wrong, 4))
    assert order > 0.95 and wrong < 0.05


def test_rows_and_lines_are_bounded(spark, monkeypatch):
    """Of a long document a stretch is learned from, of a repeated doc_id one row; empty tables give a model all the same."""
    seen = {}

    def fit(self, x, text, size, labels, **more):
        seen.update(lines=np.bincount(text).tolist(), y=labels.tolist())
        return self

    monkeypatch.setattr(quality.LineModel, "fit", fit)
    docs = spark.createDataFrame([(1, "line\n" * 900), (1, "other\nlines"), (2, "a\nb\nc"), (3, None), (None, "x"), (5, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1), (4, 1), (5, 0), (2, None)], "doc_id long, quality int")
    quality.fit(docs, labels, lines=100)
    assert seen["y"] == [1, 0, 0] and seen["lines"][0] in (100, 2) and seen["lines"][1:] == [3, 1]
    assert quality.fit(docs.limit(0), labels).weights is None and quality.fit(docs, labels.limit(0)).weights is None
    assert quality.score(docs.limit(0), quality.LineModel()).count() == 0
    assert quality.score(docs, quality.LineModel()).where("score = 0.5").count() == 6
