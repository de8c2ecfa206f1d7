"""Places where a model or a rule of one's own is plugged in, with what each must take and give.

A plug-in is a function over DataFrames (or, for a filter, over columns).  It is
registered under a kind and a name; calling it through the registry checks what it
is given and what it gives: missing columns, columns of another type, and keys that
it was not asked for are errors that say which seam was broken.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BrokenSeam(TypeError):
    """A plug-in does not keep its contract."""


@dataclass(frozen=True)
class Contract:
    """Columns that a plug-in is given and gives, as DDL types (`any`: whatever type), and the key that rows are told apart by."""

    takes: dict[str, str]
    gives: dict[str, str]
    key: str | None = None


VECTOR, BOX = "array<float>", "array<double>"
CONTRACTS = {
    # Unknown items in, those that it settles out.
    "technique": Contract({"id": "any"}, {"id": "any", "brand": "string", "score": "double"}, "id"),
    # Rows in, the raw verdict of those that it looked at out.
    "post_filter": Contract({"logo_id": "any", "content": "any"}, {"logo_id": "any", "raw": "string"}, "logo_id"),
    "embedder": Contract({"id": "any", "content": "binary"}, {"id": "any", "embedding": VECTOR}, "id"),
    # A row for each box.
    "detector": Contract({"frame": "any", "content": "binary"}, {"frame": "any", "box_xyxy": BOX, "label": "string", "score": "double"}, "frame"),
    "transcriber": Contract({"id": "any", "content": "binary"}, {"id": "any", "text": "string"}, "id"),
}
#: Types that stand for one another when only their width differs.
ALIKE = [{"float", "double"}, {"int", "bigint", "smallint", "tinyint"}, {"array<float>", "array<double>"}]
_registry: dict[tuple[str, str], Callable] = {}


def _check(what: str, df: DataFrame, columns: dict[str, str]) -> None:
    if not isinstance(df, DataFrame):
        raise BrokenSeam(f"{what}: a DataFrame is wanted, not {type(df).__name__}")
    have = dict(df.dtypes)
    for name, kind in columns.items():
        if name not in have:
            raise BrokenSeam(f"{what}: column {name} is missing; there are {', '.join(df.columns)}")
        if kind != "any" and have[name] != kind and not any({kind, have[name]} <= same for same in ALIKE):
            raise BrokenSeam(f"{what}: column {name} is {have[name]}, not {kind}")


def checked(kind: str, name: str, run: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """The plug-in with its contract checked at each call; columns beyond the contract are dropped from what it gives."""
    contract = CONTRACTS[kind]

    def call(rows: DataFrame) -> DataFrame:
        _check(f"{kind} {name} is given", rows, contract.takes)
        got = run(rows)
        _check(f"{kind} {name} gives", got, contract.gives)
        return got.select(*(F.col(c) if k == "any" else F.col(c).cast(k).alias(c) for c, k in contract.gives.items()))

    return call


def register(kind: str, name: str) -> Callable:
    """Decorator: put a function into the registry under a kind and a name."""
    if kind not in CONTRACTS:
        raise BrokenSeam(f"no kind {kind}; there are {', '.join(CONTRACTS)}")

    def add(run: Callable) -> Callable:
        if (kind, name) in _registry:
            raise BrokenSeam(f"{kind} {name} is there already")
        _registry[kind, name] = run
        return run

    return add


def get(kind: str, name: str) -> Callable[[DataFrame], DataFrame]:
    """A registered plug-in, checked."""
    if (kind, name) not in _registry:
        raise BrokenSeam(f"no {kind} {name}; there are {', '.join(n for k, n in _registry if k == kind) or 'none'}")
    return checked(kind, name, _registry[kind, name])


def remove(kind: str, name: str) -> None:
    _registry.pop((kind, name), None)


def strangers(asked: DataFrame, got: DataFrame, kind: str) -> DataFrame:
    """Rows that a plug-in gave for keys that it was not asked for; an action decides, so it is the caller's to run."""
    key = CONTRACTS[kind].key
    return got.join(asked.select(key), key, "left_anti")


def unit_length(embedded: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """An embedder's rows; one whose vector is not of length 1 stops the job."""
    norm = F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    wrong: Column = F.raise_error(F.concat(F.lit("an embedder must give unit vectors; this one has length "), norm.cast("string")))
    return embedded.withColumn("embedding", F.when(F.abs(norm - 1.0) <= tolerance, F.col("embedding")).otherwise(wrong.cast(dict(embedded.dtypes)["embedding"])))


def contract_ddl(kind: str, side: str = "gives") -> T.StructType:
    """The columns of a contract as a schema, `any` as text: for plug-ins written with mapInPandas."""
    columns = getattr(CONTRACTS[kind], side)
    return T.StructType.fromDDL(", ".join(f"`{n}` {'string' if k == 'any' else k}" for n, k in columns.items()))
