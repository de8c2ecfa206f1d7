"""Streams in shuffled micro-batches give what the batch queries give."""

import random
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.operators import timeline as L
from sightline.streaming import ordered as O

BEGIN = datetime(2024, 1, 1)


def at(seconds):
    return BEGIN + timedelta(seconds=seconds)


def run(spark, tmp_path, df, build, batches, name):
    """The rows in files of a few out-of-order batches, then one far later row of another key that moves the watermark on."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        q = build(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120), i
    return spark.read.parquet(f"{tmp_path}/out")


def batches_of(rng, rows, n, reach):
    """Rows in n batches; a row is at most `reach` places from where it belongs."""
    mixed = [r for _, r in sorted(enumerate(rows), key=lambda x: x[0] + rng.random() * reach)]
    size = -(-len(mixed) // n)
    return [mixed[k : k + size] for k in range(0, len(mixed), size)]


def test_peaks(spark, tmp_path):
    rng = random.Random(1)
    rows = [(v, at(10 * i), i, float(rng.choice([0, 1, 2, 5, 9]))) for i in range(60) for v in ("a", "b")]
    df = spark.createDataFrame([*rows, (None, at(5), 1, 1.0)], "video string, ts timestamp, frame long, ratio double")
    last = [("z", at(10**6), 0, 0.0)]
    got = run(spark, tmp_path, df, lambda s: O.stream_peaks(s, 2.0, "5 minutes"), [*batches_of(rng, rows, 3, 12), last], "p")
    peaks = L.peaks(df.where("video is not null").withColumn("threshold", F.lit(2.0)), ["video"], ["ts", "frame"], "ratio")
    key = L.keyframes(peaks.drop("threshold"), ["video"]).select("video", "pos", "keyframe")
    want = peaks.join(key, ["video", "pos"]).select("video", "frame", "pos", "ratio", "keyframe")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 10


def test_intervals_and_late_rows(spark, tmp_path):
    rng = random.Random(2)
    times = [0]
    while len(times) < 60:
        times.append(times[-1] + rng.choice([5, 20, 40, 700]))
    rows = [("v", rng.choice("xy"), at(t), i, rng.choice(["db", "db", "audio", None])) for i, t in enumerate(times)] + [("v", "UNKNOWN", at(3), 3, "db")]
    schema = "video string, brand string, ts timestamp, frame long, source string"
    df = spark.createDataFrame(rows, schema)
    late = [("v", "x", at(times[-1] + 50_000), 900, "db"), ("v", "x", at(1), 901, "late")]
    parts = [*batches_of(rng, rows, 2, 6), late[:1], late[1:], [("w", "z", at(10**6), 0, "db")]]
    got = run(spark, tmp_path, df, lambda s: O.stream_intervals(s, 300, "2 hours"), parts, "i")
    w = Window.partitionBy("video", "brand").orderBy("ts", "frame")
    kept = df.union(spark.createDataFrame(late[:1], schema)).where("brand <> 'UNKNOWN'")
    new = (F.col("ts").cast("double") - F.lag(F.col("ts").cast("double")).over(w) >= 300).cast("int")
    parted = kept.withColumn("k", F.coalesce(F.sum(new).over(w), F.lit(0))).withColumn("time", F.col("ts")).withColumn("tie", F.lit(0))
    want = L.brand_intervals(parted, ["video", "brand", "k"]).select("video", "brand", "start", "stop", "n", "source")
    assert sorted(map(tuple, got.where("video = 'v'").collect())) == sorted(map(tuple, want.collect()))
    assert got.where("source like '%late%'").count() == 0 and got.count() > 5
