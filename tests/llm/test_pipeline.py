"""The pipeline against a brute-force version of its stages."""

import re
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
from near_brute import near_components
from tokenizers import Tokenizer


def test_stages(spark, docs, texts, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sf = f"file://{tmp_path}"
    at, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf)
        assert at.columns == docs.columns
        at.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        at = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        kept[name] = {r["doc_id"]: r["text"] for r in at.collect()}
    lettered = {k: t for k, t in texts.items() if t and re.search(r"[^\W\d_]", t)}
    assert kept["language ID"] == lettered
    once = {max(k for k, t in lettered.items() if t == x): x for x in set(lettered.values())}
    assert kept["exact dedup"] == once
    group = near_components(once, 80)
    left = {k: t for k, t in once.items() if group[k] == k}
    assert kept["MinHash near-dedup"] == left
    cut = kept["substring dedup"]
    assert set(cut) == set(left) and all(cut[k] == left[k] for k in left if k not in (9, 7))
    assert len(cut[9].split()) <= 104 < 180 == len(left[9].split())

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(cut)
    for k, parts in pieces.items():
        ids = np.array([*lib.encode(cut[k], add_special_tokens=False).ids, 2], "<u4")
        assert sum(r["length"] for r in parts) == len(ids)
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in parts)


ODD = {
    "empty": [],
    "one row": [(1, "just a few words here")],
    "all null": [(None, None), (None, None)],
    "no letter": [(1, ""), (2, " \n"), (3, "12 !!"), (None, "7")],
    "equal": [(5, "the same words again and again")] * 4 + [(None, "the same words again and again")],
}


@pytest.mark.parametrize("kind", sorted(ODD))
def test_odd_tables(spark, tmp_path, kind):
    """Nulls, one row, no row: each stage gives the columns of documents, and what is left is packed whole."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(d, t, None, None, None) for d, t in ODD[kind]], schema).write.parquet(f"{tmp_path}/documents.parquet")
    at = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, f"file://{tmp_path}")
        if k < 4:
            assert at.columns == schema.replace(" long", "").replace(" string", "").split(", ")
        at.write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
    rows = at.collect()
    wanted = {"one row": {1}, "equal": {5}}.get(kind, set())
    assert {r["doc_id"] for r in rows} - {None} == wanted
    assert all(sum(r["length"] for r in rows) == r["doc_tokens"] for r in rows)  # one document is left at most
