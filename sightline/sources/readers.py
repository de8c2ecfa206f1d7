"""Readers: CSV lists, manifests, image folders, galleries, text labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Suffixes of image files.
IMAGES = ["jpg", "jpeg", "png", "webp"]
DETECTION = """det_id int, sample_idx int, frame_idx int, timecode_seconds double, label string, score double, box_xyxy array<double>, box_xyxy_enlarged array<double>,
    frame_width int, frame_height int, crop_path string, crop_enlarged_path string, temporal_frames map<string,string>"""
MANIFEST = f"video string, fps double, total_frames int, sampled_frames int, total_detections int, config string, detections array<struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in DETECTION.split(', '))}>>"
PREDICTION = """is_logo string, brand string, brand_canonical string, is_truncated boolean, logo_probability string, confidence string, signals_used array<string>, signals_used_raw array<string>, reasoning string"""
HINTS = "det_id long, faiss_top_k array<struct<brand_name: string, similarity: double>>, ocr struct<lines: array<struct<text: string, confidence: double>>, source: string>"
#: Columns of shot statistics, by the name they get here.
SHOT_STATS = {"frame": "Frame Number", "timecode": "Timecode", "ratio": "adaptive_ratio (w=2)"}
ANNOTATION = "box array<struct<labels: array<string>, sequence: array<struct<frame: int, time: double, x: double, y: double, width: double, height: double, enabled: boolean>>>>"


def csv(spark: SparkSession, path: str | list[str], required: list[str] = (), optional: dict[str, str] = {}, multiline: bool = True) -> DataFrame:  # noqa: B006
    """A CSV with a header; all columns are text but the optional ones, which are added as null of their type if absent.

    A missing required column is an error.  Fields may hold line breaks; large
    files without such fields are split among tasks with multiline=False.
    """
    df = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"').csv(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    for name, kind in optional.items():
        df = df.withColumn(name, F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind))
    return df


def brand_lists(spark: SparkSession, paths: list[str], column: str = "Company") -> DataFrame:
    """Brand lists one after another, each name once, with the place where it first stood: (brand, list, place)."""
    def one(i: int, path: str) -> DataFrame:
        df = csv(spark, path)
        name = column if column in df.columns else "Brand"
        return df.select(F.col(name).alias("brand"), F.lit(i).alias("list"), F.monotonically_increasing_id().alias("place"))

    rows = reduce(DataFrame.unionByName, [one(i, p) for i, p in enumerate(paths)]).where("brand is not null")
    turn = F.row_number().over(Window.partitionBy("brand").orderBy("list", "place"))
    return rows.withColumn("_t", turn).where("_t = 1").drop("_t")


def manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A row per detection of extraction manifests, with the video's columns; a file is one manifest, or one per line."""
    m = spark.read.schema(MANIFEST).option("multiLine", not lines).json(path)
    return m.select("video", "fps", "total_frames", F.explode("detections").alias("d")).select("video", "fps", "total_frames", "d.*")


def hints(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """Hints of detections: det_id, faiss_top_k, ocr; a file is one object, or one per line."""
    return spark.read.schema(HINTS).option("multiLine", not lines).json(path)


def predictions(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """Predictions by det_id, with the fields of PREDICTION; null fields where the answer was not parsed.

    A file without a det_id gets it from the last number in the name of its folder.
    """
    kind = "struct<" + ", ".join(x.strip().replace(" ", ": ", 1) for x in PREDICTION.split(", ")) + ">"
    p = spark.read.schema(f"det_id long, raw string, parsed {kind}").option("multiLine", not lines).json(path)
    own = F.regexp_extract(F.input_file_name(), r"(\d+)[^/\d]*/[^/]+$", 1).try_cast("long")
    return p.select(F.coalesce("det_id", own).alias("det_id"), "parsed.*")


def gallery_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a gallery's metadata list, in the columns that the file has."""
    return spark.read.option("multiLine", True).json(path)


def shot_stats(spark: SparkSession, path: str) -> DataFrame:
    """Shot statistics: frame, timecode and ratio by frame; the ratio is null in the first and last frames of a file."""
    s = csv(spark, path, list(SHOT_STATS.values()), multiline=False)
    kinds = {"frame": "long", "timecode": "string", "ratio": "double"}
    return s.select(*(F.col(f"`{c}`").try_cast(kinds[n]).alias(n) for n, c in SHOT_STATS.items()))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """A row per annotated box and time: label, frame, time, x, y, width, height (percent)."""
    a = spark.read.schema(ANNOTATION).option("multiLine", True).json(path)
    b = a.select(F.input_file_name().alias("path"), F.explode("box").alias("b")).select("path", F.col("b.labels")[0].alias("label"), F.explode("b.sequence").alias("s"))
    return b.select("path", "label", "s.frame", "s.time", "s.x", "s.y", "s.width", "s.height")


def image_files(spark: SparkSession, folder: str, labelled: bool = False, below: bool = True) -> DataFrame:
    """Image files in a folder, and below it unless told not to: path, name, content; the folder's name as brand if labelled."""
    pattern = "*.{" + ",".join([*IMAGES, *(x.upper() for x in IMAGES)]) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", below).option("pathGlobFilter", pattern).load(folder)
    out = files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")
    return out.withColumn("brand", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)) if labelled else out


def flat_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Image files in a folder itself, sorted by name."""
    return image_files(spark, folder, below=False).orderBy("name")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images: path, height, width, channels, data (blue, green, red by row); unreadable ones are left out."""
    return spark.read.format("image").option("dropInvalid", True).load(folder).select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data").withColumnRenamed("origin", "path")


def existing(rows: DataFrame, path: str, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose file is listed, and those whose file is not."""
    names = files.select(F.col("path").alias(path)).distinct()
    return rows.join(names, path, "left_semi"), rows.join(names, path, "left_anti")


def label_lines(spark: SparkSession, path: str, classes: int) -> DataFrame:
    """Detector label lines: file, line, class, x, y, w, h, and valid (class within range, five numbers)."""
    t = spark.read.text(path).select(F.input_file_name().alias("file"), F.trim("value").alias("line")).where("line <> ''")
    parts = F.split("line", r"\s+")
    number = lambda k: F.get(parts, F.lit(k)).try_cast("double")
    cls = F.get(parts, F.lit(0)).try_cast("int")
    valid = F.coalesce((cls >= 0) & (cls < classes) & (F.size(parts) == 5) & number(4).isNotNull(), F.lit(False))
    return t.select("file", "line", cls.alias("class"), number(1).alias("x"), number(2).alias("y"), number(3).alias("w"), number(4).alias("h"), valid.alias("valid"))


def gallery(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """A gallery (vec_id, embedding, brand, ...); with `dim`, a row of another length is an error."""
    g = spark.read.parquet(path)
    if dim is not None:
        wrong: Column = F.raise_error(F.concat(F.lit("embedding length "), F.size("embedding").cast("string")))
        g = g.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(wrong.cast("array<float>")))
    return g
