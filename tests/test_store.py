"""Galleries as tables of snapshots: crashes, two writers, replayed batches, and which files an append reads."""

import pytest

from sightline.sources.store import Store, VersionTaken

SCHEMA = "vec_id long, embedding array<float>, brand string"


def rows(spark, ids):
    return spark.createDataFrame([(i, [float(i), 1.0], f"b{i % 3}") for i in ids], SCHEMA)


def ids(store, version=None):
    return sorted(r["vec_id"] for r in store.read(version).collect())


def test_versions_and_replays(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/g")
    assert s.read() is None and s.snapshot().version == 0
    assert s.append(rows(spark, range(10)), ["vec_id"], "one").version == 1
    assert s.append(rows(spark, [5, 6, 20, 20]), ["vec_id"], "two").version == 2
    assert s.append(rows(spark, [99]), ["vec_id"], "one").version == 2  # stored already, whatever its rows
    assert ids(s) == [*range(10), 20] and ids(s, 1) == list(range(10))
    assert s.append(rows(spark, []), ["vec_id"]).version == 3 and ids(s) == [*range(10), 20]
    with pytest.raises(ValueError, match="no version"):
        s.read(9)
    with pytest.raises(ValueError, match="different columns"):
        s.append(rows(spark, [1]).drop("brand"), ["vec_id"])
    with pytest.raises(Exception, match="null in key column"):
        s.append(spark.createDataFrame([(None, None, None)], SCHEMA), ["vec_id"])
    assert ids(s) == [*range(10), 20]


def test_empty_first_batch(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/g")
    s.append(rows(spark, []), ["vec_id"])
    assert s.read().count() == 0 and s.read().columns == ["vec_id", "embedding", "brand"]
    s.append(rows(spark, [3]), ["vec_id"])
    assert ids(s) == [3]


def test_a_writer_that_dies_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    s = Store(spark, f"file://{tmp_path}/g")
    s.append(rows(spark, range(4)), ["vec_id"])

    def die(self, new):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Store, "commit", die)
        with pytest.raises(KeyboardInterrupt):
            s.append(rows(spark, range(8)), ["vec_id"], "late")
    assert ids(s) == [0, 1, 2, 3] and len(s.orphans()) == 1
    s.append(rows(spark, range(8)), ["vec_id"], "late")  # the same batch, started over
    assert ids(s) == list(range(8))
    assert len(s.vacuum()) == 1 and s.orphans() == [] and ids(s) == list(range(8))


def test_two_writers(spark, tmp_path, monkeypatch):
    """The other commits between this writer's look at the table and its own commit."""
    s, other = (Store(spark, f"file://{tmp_path}/g") for _ in range(2))
    s.append(rows(spark, range(4)), ["vec_id"])
    write, turns = Store._write, []

    def late(self, *args):
        out = write(self, *args)
        if self is s and not turns:
            turns.append(1)
            other.append(rows(spark, range(2, 7)), ["vec_id"], "theirs")
        return out

    monkeypatch.setattr(Store, "_write", late)
    assert s.append(rows(spark, range(5, 10)), ["vec_id"], "mine").version == 3
    assert ids(s) == list(range(10)) and s.orphans() == []
    assert sorted(s.snapshot().batches["mine"][0].items())[0] == ("high", 9)
    with pytest.raises(VersionTaken):
        s.commit(s.snapshot(2))
    assert s.versions() == [1, 2, 3]


def test_an_append_reads_keys_of_few_files(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/g")
    for at in range(0, 500, 100):
        s.append(rows(spark, range(at, at + 100)), ["vec_id"])
    files = s.snapshot().files()
    assert len(files) >= 5
    keys = lambda *x: rows(spark, x).select("vec_id")
    assert s.touched(keys(1000, -1), s.snapshot()) == []
    near = s.touched(keys(250), s.snapshot())
    assert len(near) == 1 and near[0]["low"] <= 250 <= near[0]["high"]
    assert len(s.touched(keys(0, 499), s.snapshot())) == 2


def test_text_keys(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/g")
    df = spark.createDataFrame([("é", 1), ("a", 2), ("z", 3)], "path string, n int")
    s.append(df, ["path"])
    s.append(df, ["path"])
    s.append(spark.createDataFrame([("日", 4), ("é", 9)], "path string, n int"), ["path"])
    assert sorted(map(tuple, s.read().collect())) == [("a", 2), ("z", 3), ("é", 1), ("日", 4)]
