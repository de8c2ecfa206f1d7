"""Writers: flat CSV, nested JSON, galleries that grow, and runs that resume."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Store
from .vector_file import open_folder


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that every column fits in CSV."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema))


def to_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    flat(df).write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def to_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """One object per row; nulls are written."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def frame_annotations(detections: DataFrame, path: str | None = None, mode: str = "error") -> DataFrame:
    """A row per frame with its detections in order; written as JSON if a path is given."""
    rest = [c for c in detections.columns if c not in ("frame_idx", "timecode_seconds", "frame_path", "det_id")]
    out = detections.groupBy("frame_idx").agg(F.min("timecode_seconds").alias("timecode_seconds"), F.min("frame_path").alias("frame_path"), F.array_sort(F.collect_list(F.struct("det_id", *rest))).alias("detections"))
    if path:
        to_json(out, path, mode)
    return out


def split_known(df: DataFrame, path: str, mode: str = "error") -> None:
    """Rows in folders by whether their brand is known."""
    df.withColumn("is_known", F.coalesce("brand", F.lit("UNKNOWN")) != "UNKNOWN").write.mode(mode).partitionBy("is_known").parquet(path)


def verdicts_csv(annotated: DataFrame, path: str, mode: str = "error") -> None:
    """All rows with their verdicts, and beside them those that are kept."""
    to_csv(annotated, f"{path}/with_verdicts", mode)
    to_csv(annotated.where("kept"), f"{path}/filtered", mode)


def brand_object(brands: DataFrame, source: str, model: str) -> DataFrame:
    """One row: source, model, count, and the distinct brands in order (a list for a person, thus small)."""
    names = F.array_sort(F.collect_set("brand"))
    return brands.where("brand is not null").agg(names.alias("brands")).select(F.lit(source).alias("source"), F.lit(model).alias("model"), F.size("brands").alias("count"), "brands")


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Each row's content as a file of its own, by the tasks that hold the rows; path and size of each, once they are read.

    A file is written under a passing name and then gets its own, so a task that is
    run again leaves whole files only.  Rows without a name or content are left out.
    Names are plain: one with a slash stops the job.
    """
    base = folder.rstrip("/")

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, at = open_folder(base)
        files.create_dir(at, recursive=True)
        for b in batches:
            sizes = []
            for n, data in zip(b["name"], b["content"], strict=True):
                if "/" in n:
                    raise ValueError(f"{n} is no plain name")
                made = f"{at}/.{uuid.uuid4().hex}"
                with files.open_output_stream(made) as f:
                    f.write(data)
                files.move(made, f"{at}/{n}")
                sizes.append(len(data))
            yield pd.DataFrame({"path": base + "/" + b["name"], "size": sizes})

    wanted = rows.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content"))
    return wanted.where("name is not null and content is not null").mapInPandas(put, "path string, size long")


def canonical_map_json(mapping: DataFrame, path: str, name: str = "brand", canonical: str = "brand_canonical", mode: str = "error") -> DataFrame:
    """One JSON object from names to their canonical spelling, in the order of names; also returned.

    A list for a person, thus small.  Of several spellings of a name the first by
    letters is taken; blank names and spellings are left out.
    """
    rows = mapping.select(F.trim(name).alias("k"), F.trim(canonical).alias("v")).where("k <> '' and v <> ''").groupBy("k").agg(F.min("v").alias("v"))
    out = rows.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v"))))).alias("value"))
    out.coalesce(1).write.mode(mode).text(path)
    return out


def comparison_table(df: DataFrame, order: str = "recall_at_1", rows: int = 50) -> str:
    """The best rows of a summary as text for a terminal, numbers with four places, columns aligned."""
    four = [F.format_string("%.4f", c).alias(c) if t in ("double", "float") else F.col(c).cast("string").alias(c) for c, t in df.dtypes]
    top = [[c or "" for c in r] for r in df.orderBy(F.desc(order), *(c for c in df.columns if c != order)).select(*four).limit(rows).collect()]
    width = [max(map(len, column)) for column in zip(df.columns, *top, strict=True)]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, width, strict=True)).rstrip() for r in [df.columns, ["-" * w for w in width], *top])


def append_new(df: DataFrame, path: str, key: list[str], batch: str | None = None) -> DataFrame:
    """Append the rows whose key is not stored yet to a table of snapshots, and return that (store.Store).

    Running it again with the same rows adds nothing, so a job that broke off
    can be started over; neither does a batch whose name is stored already.
    """
    store = Store(df.sparkSession, path)
    return store.read(store.append(df, key, batch).version)


def summary_csv(df: DataFrame, path: str, order: str = "recall_at_1", mode: str = "error") -> None:
    """A small summary, best first, numbers with four places."""
    four = [F.format_string("%.4f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.orderBy(F.desc(order)).select(*four).coalesce(1).write.mode(mode).option("header", True).csv(path)
