"""Helpers shared by the operators: shared-folder tables, safe columns, components."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).

    Only where the setting is absent on one machine (local mode) is a folder of
    our own made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        ready = spark.sparkContext._jsc.sc().getCheckpointDir()
        if ready.isDefined():
            folder = ready.get()
        elif not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        else:
            folder = "file://" + os.path.join(tempfile.gettempdir(), f"sightline-{uuid.uuid4().hex}")
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sightline-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has made; results not yet written are lost."""
    _delete(spark, _own_dir(spark))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts lineage and survives the loss of executors.  Results may still be
    read from the table later, so it stays until `discard` or `clear`.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{re.sub('[^a-z0-9]', '_', name.lower())}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sightline_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by `materialize` that no later result reads."""
    if path := getattr(df, "_sightline_path", None):
        _delete(df.sparkSession, path)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Texts are long rows: at most `rows` of them, or about `size` bytes, go to a Python worker of this session at a time.

    Both settings of the session stay so, since results are read after the
    operator has returned; smaller ones are left as they are.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key, None) or "0"
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def _trim() -> None:
    """Give memory that is free back to the system; workers live on, and the next task may need it elsewhere."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def _map_large() -> None:
    """Arrays of 1 MB or more get pages of their own, which go back to the system as soon as they are freed."""
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which else grows with what is freed
    except (OSError, AttributeError):  # not every C library has it
        pass


def lean(run: Callable) -> Callable:
    """A function over batches whose Python worker holds no more than it needs when a task ends."""

    def wrapped(batches):
        _map_large()
        yield from run(batches)
        _trim()

    return wrapped


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """doc_id and text (null counts as empty), whatever other columns there are."""
    small_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def tasks(spark: SparkSession, least: int = 1) -> int:
    """Partitions for shuffles that are set by hand."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bits that the map of ids has for each of them, and its words at most (64 bits each: 8 MB in all).
MAP_BITS, MAP_WORDS = 16, 1 << 20


def mark_maybe(df: DataFrame, ids: DataFrame, column: str, flag: str) -> DataFrame:
    """df with a column `flag`: false for most values of a column that are not in ids(id), true for all that are.

    For rows that are costly to shuffle: only those that may match go on to an
    exact join.  The map has MAP_BITS bits an id and MAP_WORDS words at most, so
    it is broadcast.  The more ids there are beyond MAP_WORDS * 64 / MAP_BITS,
    the more rows are marked without need; the results are the same.
    """
    words = 1 << max(10, (ids.count() * MAP_BITS // 64).bit_length())
    words = min(words, MAP_WORDS)

    def place(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(64 * words))

    at, w, bits = (fresh(df, n) for n in ("_place", "_w", "_bits"))
    map_ = ids.select(place(F.col("id").cast("long")).alias("p")).groupBy(F.expr("shiftright(p, 6)").alias(w)).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias(bits))
    df = df.withColumn(at, place(F.col(column).cast("long")))
    near = df.join(F.broadcast(map_), F.shiftright(df[at], 6) == map_[w], "left")
    hit = F.expr(f"coalesce((shiftright(`{bits}`, cast(`{at}` % 64 as int)) & 1L) = 1L, false)")
    return near.withColumn(flag, hit).drop(at, w, bits)


def without_ids(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is not in gone(id); only rows that may be in it are shuffled."""
    gone = materialize(gone.where("id is not null").distinct(), "gone")
    flag = fresh(docs, "_maybe")
    marked = mark_maybe(docs, gone, "doc_id", flag)
    unsure = marked.where(F.col(flag))
    unsure = unsure.join(gone, unsure["doc_id"] == gone["id"], "left_anti")
    return marked.where(~F.col(flag)).unionByName(unsure).drop(flag)


#: Edges that one task contracts by itself.
TASK_EDGES = 500_000


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least index of each of n nodes' component under edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's edges as stars: (u, v) with v the least id that u reaches by them."""
    parts = list(batches)
    if not parts:
        return
    ids, ends = np.unique(np.concatenate([p[["u", "v"]].to_numpy(np.int64).ravel() for p in parts]), return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    root = ids[forest(a, b, len(ids))]
    yield pd.DataFrame({"u": ids[ids != root], "v": root[ids != root]})


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b): one row (id, component_id) per endpoint.

    component_id is the smallest id reachable.  Tasks of at most TASK_EDGES
    edges contract them to stars; beyond one task the large-star and small-star
    steps alternate on tables in the shared folder until the edge set stands
    still.  A count or a checksum comes to the driver, nothing else.
    """
    all_ = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null").distinct(), "edges")
    parts = -(-max(1, all_.count()) // TASK_EDGES)
    e = materialize(all_.where("u <> v").repartition(parts).mapInPandas(lean(_contract), "u long, v long"), "edges")
    before = None
    for _ in range(rounds if parts > 1 else 0):
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("s")).select("s.u", "s.v").where("u <> v").distinct()
        new = materialize(small, "edges")
        sum_ = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(e)
        e = new
        if before == tuple(sum_):
            break
        before = tuple(sum_)
    else:
        if parts > 1:
            raise RuntimeError("components did not settle")
    linked = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id"))
    return linked.unionByName(all_.select("v").union(all_.where("u = v").select("u")).distinct().join(e.select(F.col("u").alias("v")), "v", "left_anti").select(F.col("v").alias("id"), F.col("v").alias("component_id")))
