"""Picture files: written, read by the image source, and measured, large ones in strips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import images as I
from sightline.sources import readers, writers


def picture(rng, h, w, c):
    y, x = np.mgrid[0:h, 0:w]
    p = 90 + 60 * np.sin(x / 5)[:, :, None] + 50 * (y > h / 2)[:, :, None] + rng.normal(0, 9, (h, w, c))
    return np.clip(p, 0, 255).astype(np.uint8)


def test_files_give_back_the_pixels(spark, tmp_path):
    rng = np.random.default_rng(5)
    made = {f"{c}-{h}.png": picture(rng, h, w, c) for h, w, c in ((9, 7, 3), (20, 33, 1), (1, 1, 3), (64, 64, 3))}
    rows = spark.createDataFrame([(n, p.tobytes(), *p.shape) for n, p in made.items()] + [("wrong.png", b"123", 5, 5, 1), (None, b"1", 1, 1, 1)], "name string, data binary, h int, w int, c int")
    files = rows.withColumn("content", I.png("data", "h", "w", "c"))
    more = spark.createDataFrame([("text.png", b"no picture"), ("cut.png", I.encode_png(made["1-20.png"])[:40]), ("notes.txt", b"x")], "name string, content binary")
    folder = f"file://{tmp_path}/pictures"
    got = writers.write_files(files.select("name", "content").unionByName(more), folder)
    assert got.count() == len(made) + 3
    back = {r["path"].rsplit("/", 1)[1]: r for r in readers.images(spark, folder).collect()}
    assert sorted(back) == sorted(made)  # broken files are left out
    for n, p in made.items():
        assert (back[n]["height"], back[n]["width"], back[n]["channels"]) == p.shape and bytes(back[n]["data"]) == p.tobytes()
    found = readers.images(spark, folder).select("path", *(f("data", "height", "width", "channels").alias(k) for k, f in (("texture", I.texture), ("edges", I.edge_share), ("colour", I.colour_spread)))).collect()
    for r in found:
        p = made[r["path"].rsplit("/", 1)[1]].astype(float)
        g = p[:, :, 0] if p.shape[2] == 1 else p @ [0.114, 0.587, 0.299]
        assert np.allclose([r["texture"], r["colour"]], [g.std(), p.reshape(-1, p.shape[2]).std(0).mean()])
        assert 0 <= r["edges"] <= 1
    with pytest.raises(Exception, match="no plain name"):
        writers.write_files(more.withColumn("name", F.lit("a/b.png")), folder).count()


def test_strips_give_the_same(monkeypatch):
    rng = np.random.default_rng(6)
    p = picture(rng, 61, 47, 3)
    p[10:12, :] = 255
    whole = I.edges(p), I.spread(p), I.grey_spread(p)
    assert whole[0].any()
    for pixels in (47, 47 * 2, 47 * 7):
        monkeypatch.setattr(I, "STRIP", pixels)
        assert np.array_equal(I.edges(p), whole[0]) and np.allclose([I.spread(p), I.grey_spread(p)], whole[1:])


def test_weak_edges_count_only_beside_strong_ones():
    g = np.zeros((12, 30, 1), np.uint8)
    g[6:, :15], g[6:, 15:] = 60, 18  # a strong step that goes on as a weak one
    g[6:, 28:] = 0
    e = I.edges(g)
    assert e[5:7, 2:27].any(0).all()
    g[6:, :15] = 18
    assert not I.edges(g).any()
