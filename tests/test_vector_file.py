"""Flat index files: round trips, several partitions, and files that are wrong."""

import os
import struct

import numpy as np
import pytest

from sightline.sources import vector_file as V

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_round_trip(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id", "embedding", "concat('b\"é', label) as brand")
    V.write_index(e.repartition(5), f"file://{tmp_path}/g", labels=f"file://{tmp_path}/names.json")
    back = V.read_index(spark, f"file://{tmp_path}/g", f"file://{tmp_path}/names.json", dim=64, rows_per_partition=7)
    rows = V.read_index(spark, f"file://{tmp_path}/g", rows_per_partition=7)
    assert rows.rdd.getNumPartitions() > 3
    want = [(list(r["embedding"]), r["brand"]) for r in e.orderBy("vec_id").collect()]
    assert [(r["vec_id"], list(r["embedding"]), r["brand"]) for r in back.orderBy("vec_id").collect()] == [(i, v, b) for i, (v, b) in enumerate(want)]
    assert not [f for f in os.listdir(f"{tmp_path}/g") if not f.endswith(".index") and not f.endswith(".crc")]


def put(path, vectors, mark=b"IxF2", metric=1, cut=0, more=b""):
    n, d = vectors.shape
    head = mark + struct.pack("<i", d) + struct.pack("<q", n) + struct.pack("<qq", 1 << 20, 1 << 20) + b"\x01" + struct.pack("<i", metric) + struct.pack("<Q", n * d)
    raw = head + vectors.astype("<f4").tobytes() + more
    path.write_bytes(raw[: len(raw) - cut])
    return f"file://{path}"


def test_one_file_by_row_offsets(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(50, 3)).astype(np.float32)
    path = put(tmp_path / "one", x, b"IxFI", 0)
    df = V.read_index(spark, path, rows_per_partition=8)
    assert df.rdd.getNumPartitions() == 7
    assert np.array_equal(np.array([r["embedding"] for r in df.orderBy("vec_id").collect()], np.float32), x)
    assert V.read_index(spark, put(tmp_path / "none", x[:0])).count() == 0


@pytest.mark.parametrize(
    ("kind", "says"),
    [(dict(cut=1), "bytes, not the"), (dict(cut=60 * 4 + 40), "no header|bytes, not the"), (dict(more=b"x"), "bytes, not the"), (dict(mark=b"IxHN"), "no flat index"), (dict(metric=22), "no flat index")],
)
def test_wrong_files(spark, tmp_path, kind, says):
    path = put(tmp_path / "bad", np.ones((20, 3)), **kind)
    with pytest.raises(Exception, match=says):
        V.read_index(spark, path).count()


def test_wrong_dimension_labels_and_rows(spark, tmp_path):
    path = put(tmp_path / "x", np.ones((4, 3)))
    with pytest.raises(Exception, match="vectors of 3, not 64"):
        V.read_index(spark, path, dim=64).count()
    (tmp_path / "l.json").write_text('["a", "b"]')
    with pytest.raises(ValueError, match="4 vectors and 2 labels"):
        V.read_index(spark, path, f"file://{tmp_path}/l.json")
    with pytest.raises(Exception, match="components in one file"):
        V.write_index(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>").coalesce(1), f"file://{tmp_path}/w")
    with pytest.raises(Exception, match="no place for null"):
        V.write_index(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"), f"file://{tmp_path}/w2")
    with pytest.raises(Exception, match="missing|FileNotFound"):
        V.read_index(spark, f"file://{tmp_path}/missing").count()
