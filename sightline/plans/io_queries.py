"""Round trips through the sinks and sources, and batch forms of the streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import images as I
from ..sources import readers, vector_file, writers
from ..streaming import presence
from .base import query, shared_folder, table


@query("SELECT filepath, brand, correction, source FROM [known]")
def csv_round_trip(spark, sf):
    path = shared_folder(spark)
    writers.to_csv(table(spark, sf, "known").select("filepath", "brand", "correction", "source"), path)
    return readers.csv(spark, path, ["filepath", "brand"], {"correction": "string", "source": "string"})


@query("SELECT frame AS frame_idx, det AS det_id, label, round(score, 4) AS score, round(x1, 2) AS x1, round(y2, 2) AS y2 FROM [boxes]")
def manifest_round_trip(spark, sf):
    path = shared_folder(spark)
    b = table(spark, sf, "boxes")
    d = F.struct(F.col("det").alias("det_id"), F.lit(0).alias("sample_idx"), F.col("frame").cast("int").alias("frame_idx"), F.lit(0.0).alias("timecode_seconds"), "label", F.round("score", 4).alias("score"), F.array(*(F.round(c, 2) for c in ("x1", "y1", "x2", "y2"))).alias("box_xyxy"))
    m = b.groupBy((F.col("frame") % 64).alias("v")).agg(F.collect_list(d).alias("detections")).select(F.concat(F.lit("v"), F.col("v").cast("string")).alias("video"), F.lit(25.0).alias("fps"), F.lit(100).alias("total_frames"), "detections")
    writers.to_json(m, path)
    r = readers.manifest(spark, path, lines=True)
    return r.select(F.col("frame_idx").cast("long").alias("frame_idx"), "det_id", "label", "score", F.col("box_xyxy")[0].alias("x1"), F.col("box_xyxy")[3].alias("y2"))


@query("SELECT vec_id, label FROM {embeddings}")
def resumable_append(spark, sf):
    """Half the gallery, then all of it twice: nothing is stored twice."""
    path = shared_folder(spark)
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    for part in (e.where("vec_id % 2 = 0"), e, e):
        out = writers.append_new(part, path, ["vec_id"])
    return out


@query("SELECT frame AS frame_idx, count(*) AS n, min(det) AS first FROM [boxes] GROUP BY frame")
def frame_annotations(spark, sf):
    b = table(spark, sf, "boxes").select(F.col("frame").alias("frame_idx"), F.lit(0.0).alias("timecode_seconds"), F.lit("f").alias("frame_path"), F.col("det").alias("det_id"), "label", "score")
    return writers.frame_annotations(b).select("frame_idx", F.size("detections").cast("long").alias("n"), F.col("detections")[0]["det_id"].alias("first"))


@query("""WITH e AS (SELECT user_id % 50 AS video, event_type AS brand, ts, value FROM {events} WHERE event_type <> 'error'), g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 600 SECOND THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY video, brand ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY video, brand ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT video, brand, min(ts) AS start, max(ts) + INTERVAL 600 SECOND AS stop, count(*) AS n, max(value) AS score FROM s GROUP BY video, brand, k""")
def presence_sessions(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 50).alias("video"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("brand"), "ts", F.col("value").alias("score"))
    s = presence.sessions(e)
    return s.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("stop", F.col("stop").cast("timestamp_ntz"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS brand, count(*) AS n FROM {events} GROUP BY ALL")
def presence_counts(spark, sf):
    e = table(spark, sf, "events").select("ts", F.col("event_type").alias("brand"))
    return presence.counts(e).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query()
def image_filters(spark, sf):
    """Statistics of pictures made of the embeddings' bytes, 8 by 8 pixels of one channel (there are no image tables)."""
    e = table(spark, sf, "embeddings").select("vec_id", F.unhex(F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), (x * 255 + 128).cast("int")))), 2, "0")), "")).alias("data"))
    size = (F.lit(8), F.lit(8), F.lit(1))
    s = e.select("vec_id", *(F.round(f("data", *size), 4).alias(n) for n, f in (("texture", I.texture), ("edges", I.edge_share), ("colour", I.colour_spread))))
    return s.withColumn("kept", (F.col("texture") >= I.LEAST_TEXTURE) & (F.col("edges") >= I.LEAST_EDGES) & (F.col("colour") >= I.LEAST_COLOUR))


@query("""WITH p AS (SELECT vec_id // 64 AS picture, unnest(embedding) AS x FROM {embeddings})
    SELECT concat('p', CAST(picture AS STRING), '.png') AS name, 64 AS width, CAST(count(*) // 64 AS INT) AS height, round(stddev_pop(CAST(least(255, greatest(0, trunc(x * 255e0 + 128))) AS DOUBLE)), 6) AS texture FROM p GROUP BY picture""")
def picture_files(spark, sf):
    """Every 64 vectors as the rows of a grey picture, written as PNG files beside files that are none, read by the image source and measured."""
    path = shared_folder(spark)
    e = table(spark, sf, "embeddings")
    row = F.unhex(F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), (x.cast("double") * 255 + 128).cast("int")))), 2, "0")), ""))
    rows = e.select(F.expr("vec_id div 64").alias("picture"), "vec_id", row.alias("row"))
    pictures = rows.groupBy("picture").agg(F.sort_array(F.collect_list(F.struct("vec_id", "row"))).alias("r"))  # 64 rows at most
    data = F.aggregate("r", F.lit(b""), lambda a, r: F.concat(a, r["row"]))
    files = pictures.select(F.concat(F.lit("p"), F.col("picture").cast("string"), F.lit(".png")).alias("name"), I.png(data, F.size("r"), F.lit(64), F.lit(1)).alias("content"))
    broken = files.select(F.concat(F.lit("broken-"), "name").alias("name"), F.expr("substring(content, 1, 20)").alias("content"))
    writers.write_files(files.unionByName(broken), path).agg(F.sum("size")).collect()  # one number; the files are written now
    read = readers.images(spark, path)
    size = ("height", "width", "channels")
    return read.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "width", "height", F.round(I.texture("data", *size), 6).alias("texture"))


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, concat('b', CAST(label AS STRING)) AS brand, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[64] AS DOUBLE), 6) AS last FROM {embeddings}")
def index_file_round_trip(spark, sf):
    """The gallery as flat index files with a list of labels, read again by row offsets."""
    path = shared_folder(spark)
    vector_file.write_index(table(spark, sf, "vectors"), f"{path}/index", labels=f"{path}/labels.json")
    back = vector_file.read_index(spark, f"{path}/index", f"{path}/labels.json", dim=64)
    return back.select(F.col("vec_id").alias("row"), "brand", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.round(F.col("embedding")[63].cast("double"), 6).alias("last"))
