"""Flat binary vector indexes as a Spark data source, with their labels as a JSON list.

A file holds a header (kind, dimension, number of vectors, metric), a count of
floats, and the vectors in row order as little-endian 32-bit floats.  It is read by
row offsets, a partition for every `rows_per_partition` rows; header, kind, dimension
and length of the file are checked before any row is read.  A folder of such files is
read in the order of their names, row numbers going on from file to file.  Files are
opened by Arrow's file systems, so a path may be local or on a store that Arrow knows.

    spark.dataSource.register(VectorIndex)
    spark.read.format("vector_index").option("dim", 64).load(path)
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Kinds of flat index by their mark and metric number; a number that the header repeats.
KINDS = {b"IxFI": 0, b"IxF2": 1, b"IxFl": 1}
FILLER = 1 << 20
#: Mark, dimension, vectors, two fillers, trained, metric, floats that follow.
HEADER = struct.Struct("<4siqqq?iQ")
SUFFIX = ".index"


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(f"file://{path.removeprefix('file:')}")


@dataclass
class Rows(InputPartition):
    """Rows of one file: how many to pass over, how many to read, and the number of the first."""

    file: str
    skip: int
    rows: int
    first: int
    dim: int


@dataclass
class Written(WriterCommitMessage):
    made: str
    name: str


def header(files: fs.FileSystem, path: str, dim: int | None) -> tuple[int, int]:
    """Dimension and number of vectors of a file; a ValueError says what is wrong with it."""
    size = files.get_file_info(path).size
    with files.open_input_file(path) as f:
        raw = f.read(HEADER.size)
    if len(raw) < HEADER.size:
        raise ValueError(f"{path}: {size} bytes are no header")
    mark, d, n, _, _, _, metric, floats = HEADER.unpack(raw)
    if mark not in KINDS or metric not in (0, 1):
        raise ValueError(f"{path}: no flat index of a known metric ({mark!r}, {metric})")
    if d <= 0 or n < 0 or floats != d * n:
        raise ValueError(f"{path}: the header says {n} vectors of {d} and {floats} floats")
    if dim is not None and d != dim:
        raise ValueError(f"{path}: vectors of {d}, not {dim}")
    if size != HEADER.size + 4 * floats:
        raise ValueError(f"{path}: {size} bytes, not the {HEADER.size + 4 * floats} that the header asks for")
    return d, n


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.dim = int(options["dim"]) if "dim" in options else None
        self.most = int(options.get("rows_per_partition", 1 << 20))

    def partitions(self) -> list[Rows]:
        files, at = open_folder(self.path)
        info = files.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        names = [at] if info.is_file else sorted(f.path for f in files.get_file_info(fs.FileSelector(at)) if f.is_file and f.base_name.endswith(SUFFIX))
        out, first, dim = [], 0, self.dim
        for name in names:
            dim, n = header(files, name, dim)
            out += [Rows(name, k, min(self.most, n - k), first + k, dim) for k in range(0, n, self.most)]
            first += n
        return out

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no rows at all
            return
        files, _ = open_folder(self.path)
        step = max(1, (4 << 20) // (4 * partition.dim))
        with files.open_input_file(partition.file) as f:
            f.seek(HEADER.size + 4 * partition.dim * partition.skip)
            for at in range(0, partition.rows, step):
                n = min(step, partition.rows - at)
                raw = f.read(4 * partition.dim * n)
                if len(raw) < 4 * partition.dim * n:
                    raise ValueError(f"{partition.file}: ends within a vector")
                values = pa.array(np.frombuffer(raw, "<f4"))
                ids = np.arange(partition.first + at, partition.first + at + n)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * partition.dim, values)], names=["vec_id", "embedding"])


class Writer(DataSourceArrowWriter):
    """Every task writes a file of its own under a passing name; they get their names when all are done."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind = options["path"], options.get("metric", "l2")
        if self.kind not in ("l2", "ip"):
            raise ValueError(f"metric {self.kind}: l2 or ip")
        if overwrite:
            raise ValueError("an index is not overwritten; write to another folder")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, at = open_folder(self.path)
        files.create_dir(at, recursive=True)
        made = f"{at}/.{uuid.uuid4().hex}"
        mark, metric = (b"IxF2", 1) if self.kind == "l2" else (b"IxFI", 0)
        dim = n = 0
        # The number of rows is known at the end, and a store may not take back what is written: vectors go to a file of their own first.
        with files.open_output_stream(f"{made}.body") as f:
            for b in iterator:
                column = b.column("embedding")
                if column.null_count or column.flatten().null_count:
                    raise ValueError("an index has no place for null vectors or components")
                size = np.diff(column.offsets.to_numpy())
                if len(size):
                    dim = dim or int(size[0])
                    if (size != dim).any() or not dim:
                        raise ValueError(f"vectors of {sorted(set(size.tolist()))} components in one file")
                    f.write(np.ascontiguousarray(column.flatten().to_numpy(), "<f4").tobytes())
                    n += len(size)
        with files.open_output_stream(made) as f, files.open_input_stream(f"{made}.body") as body:
            f.write(HEADER.pack(mark, dim or 1, n, FILLER, FILLER, True, metric, dim * n))
            while part := body.read(8 << 20):
                f.write(part)
        files.delete_file(f"{made}.body")
        return Written(made, f"{at}/part-{TaskContext.get().partitionId():06d}{SUFFIX}")

    def commit(self, messages: list[Written | None]) -> None:
        files, _ = open_folder(self.path)
        for m in messages:
            if m:
                files.move(m.made, m.name)

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = open_folder(self.path)
        for m in messages:
            if m and files.get_file_info(m.made).is_file:
                files.delete_file(m.made)


class VectorIndex(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vector_index"

    def schema(self) -> str:
        return "vec_id long, embedding array<float>"

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def read_index(spark: SparkSession, path: str, labels: str | None = None, dim: int | None = None, label: str = "brand", rows_per_partition: int = 1 << 20) -> DataFrame:
    """vec_id, embedding and, with a file of labels, the label of each row.

    The labels are one JSON list in row order; as many as there are vectors, or
    it is an error.  The list is one document, so one task parses it.
    """
    spark.dataSource.register(VectorIndex)
    reader = spark.read.format("vector_index").option("rows_per_partition", rows_per_partition)
    rows = (reader.option("dim", dim) if dim is not None else reader).load(path)
    if labels is None:
        return rows
    names = spark.read.text(labels, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("_at", label))
    n, m = rows.count(), names.count()
    if n != m:
        raise ValueError(f"{n} vectors and {m} labels")
    return rows.join(names, F.col("vec_id") == F.col("_at"), "left").drop("_at")


def write_index(gallery: DataFrame, path: str, order: str = "vec_id", labels: str | None = None, label: str = "brand", metric: str = "l2") -> None:
    """A gallery as a folder of flat index files, rows in `order`, and its labels as one JSON list.

    Row numbers in the files count from 0 in that order.  The list of labels is one
    document for its readers; it is written by one task, row by row.
    """
    spark = gallery.sparkSession
    spark.dataSource.register(VectorIndex)
    rows = gallery.repartitionByRange(order).sortWithinPartitions(order)
    rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).write.format("vector_index").option("metric", metric).mode("append").save(path)
    if labels is not None:
        files, at = open_folder(labels)
        with files.open_output_stream(at) as f:
            f.write(b"[")
            for i, r in enumerate(gallery.select(order, label).orderBy(order).toLocalIterator(prefetchPartitions=True)):
                f.write((", " if i else "").encode() + json.dumps(r[label], ensure_ascii=False).encode())
            f.write(b"]")
