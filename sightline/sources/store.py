"""A gallery that grows by batches, as a table of snapshots.

A folder holds `data/` with a folder of rows for each batch and `snapshots/` with one
JSON manifest for each version: the schema, the batches, and for every file the
least and largest value of the first key column.  A batch is visible from the moment
its manifest is there, which is the rename of a finished file to a name that must not
exist; that is one step on stores whose rename is (HDFS and the like).  So a job that
dies while it writes leaves rows that nobody reads; of two writers one finds its
version taken, looks at what is new and tries again; and a batch that is already in a
manifest is not written twice.

An append reads keys only from the files whose range holds one of the new keys.
Keys must not be null.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class VersionTaken(Exception):
    """Another writer has committed this version."""


@dataclass
class Snapshot:
    """What a manifest says: the version, the schema, and of each batch its files with rows and key range."""

    version: int = 0
    schema: dict | None = None
    key: list[str] = field(default_factory=list)
    batches: dict[str, list[dict]] = field(default_factory=dict)

    def files(self) -> list[dict]:
        return [f for b in self.batches.values() for f in b]


class Store:
    """The table of snapshots in one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        """All versions, ascending."""
        at = self._path("snapshots")
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version's manifest, by default the newest; version 0 is the empty table."""
        have = self.versions()
        version = (have[-1] if have else 0) if version is None else version
        if version == 0:
            return Snapshot()
        if version not in have:
            raise ValueError(f"no version {version} of {self.path}")
        stream = self.fs.open(self._path(f"snapshots/v{version:08d}.json"))
        try:
            return Snapshot(**json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()))
        finally:
            stream.close()

    def commit(self, new: Snapshot) -> None:
        """Make a version visible; VersionTaken if another writer was faster."""
        made = self._path(f"snapshots/.{uuid.uuid4().hex}")
        out = self.fs.create(made, False)
        try:
            out.write(bytearray(json.dumps(new.__dict__).encode()))
        finally:
            out.close()
        options = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.conf)
        try:
            files.rename(made, self._path(f"snapshots/v{new.version:08d}.json"), self.spark.sparkContext._gateway.new_array(options, 0))
        except Py4JJavaError as e:
            self.fs.delete(made, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise VersionTaken(new.version) from e
            raise

    def _full(self, file: dict) -> str:
        return f"{self.path}/data/{file['name']}"

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, or None where nothing was ever stored."""
        return self._rows(s, s.files()) if (s := self.snapshot(version)).schema else None

    def _rows(self, of: Snapshot, files: list[dict]) -> DataFrame:
        schema = T.StructType.fromJson(of.schema)
        return self.spark.read.schema(schema).parquet(*map(self._full, files)) if files else self.spark.createDataFrame([], schema)

    def touched(self, keys: DataFrame, of: Snapshot) -> list[dict]:
        """The files whose key range holds one of keys (one column)."""
        files = of.files()
        if not files:
            return []
        name = keys.columns[0]
        low, high = (np.array([f[x] for f in files], object) for x in ("low", "high"))

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hit = np.zeros(len(files), bool)
            for b in batches:
                if len(b):
                    sorted_ = np.sort(b[name].to_numpy(object))
                    hit |= np.searchsorted(sorted_, low, "left") < np.searchsorted(sorted_, high, "right")
            yield pd.DataFrame({"file": np.flatnonzero(hit)})

        return [files[r["file"]] for r in keys.mapInPandas(look, "file int").distinct().orderBy("file").collect()]  # a row a file, as the manifest has

    def append(self, df: DataFrame, key: list[str], batch: str | None = None, tries: int = 10) -> Snapshot:
        """Store the rows whose key is not stored yet, as one batch; the snapshot that has them.

        batch: its name; one that is stored already adds nothing, whatever its
        rows.  Of rows with one key in df any one is stored.  The first key column
        is a number or text.
        """
        batch = batch or uuid.uuid4().hex
        kinds = dict(df.dtypes)
        if kinds[key[0]] not in ("string", "int", "bigint", "smallint", "tinyint"):
            raise ValueError(f"the first key column must be a whole number or text, not {kinds[key[0]]}")
        for c in key:
            df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null in key column {c}")).cast(kinds[c])).otherwise(F.col(c)))
        for _ in range(tries):
            base = self.snapshot()
            if batch in base.batches:
                return base
            if base.schema and (base.key != key or T.StructType.fromJson(base.schema) != _loose(df.schema)):
                raise ValueError("rows and stored table have different columns or keys")
            files = self._write(df, key, base)
            new = Snapshot(base.version + 1, json.loads(_loose(df.schema).json()), key, base.batches | {batch: files})
            try:
                self.commit(new)
                return new
            except VersionTaken:
                # What was written may hold rows that the other writer has stored.
                self.fs.delete(self._path(f"data/{files[0]['name'].rsplit('/', 1)[0]}"), True) if files else None
        raise RuntimeError(f"{tries} other writers were faster")

    def _write(self, df: DataFrame, key: list[str], base: Snapshot) -> list[dict]:
        """The new rows in files by ranges of the key; name, rows and key range of each."""
        rows = df.dropDuplicates(key)
        if old := self.touched(rows.select(key[0]), base):
            rows = rows.join(self._rows(base, old).select(*key), key, "left_anti")
        folder = uuid.uuid4().hex  # another one each time: a dead try is never mixed with a new one
        at = f"{self.path}/data/{folder}"
        rows.repartitionByRange(key[0]).select(*df.columns).write.parquet(at)
        first = F.col(key[0])
        written = self.spark.read.schema(_loose(df.schema)).parquet(at)
        found = written.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("rows"), F.min(first).alias("low"), F.max(first).alias("high")).orderBy("low", "name").collect()  # a row a file
        return [r.asDict() | {"name": f"{folder}/{r['name']}"} for r in found]

    def orphans(self) -> list[str]:
        """Folders of data that no version has: what dead writers left, and what writers are about to commit."""
        at = self._path("data")
        known = {f["name"].split("/")[0] for v in self.versions() for f in self.snapshot(v).files()}
        return sorted(n for s in (self.fs.listStatus(at) if self.fs.exists(at) else []) if (n := s.getPath().getName()) not in known)

    def vacuum(self) -> list[str]:
        """Delete the orphans; only while nobody writes."""
        gone = self.orphans()
        for name in gone:
            self.fs.delete(self._path(f"data/{name}"), True)
        return gone


def _loose(schema: T.StructType) -> T.StructType:
    """The schema as Parquet gives it back: everything may be null."""

    def loose(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.StructType):
            return T.StructType([T.StructField(f.name, loose(f.dataType), True) for f in kind])
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(loose(kind.elementType), True)
        return T.MapType(loose(kind.keyType), loose(kind.valueType), True) if isinstance(kind, T.MapType) else kind

    return loose(schema)
