"""Exact nearest neighbours over a gallery in blocks that the triangle inequality rules out.

Pivots are drawn from the gallery by hash.  Every row lies in the cell of its nearest
pivot, and cells are cut into blocks by the distance to the pivot (rings), rings of
too many rows by hash.  A query first looks into its nearest block; the k-th
distance found there, or a bound from the rings alone, is its radius.  It then
visits the blocks whose lower bound (ring distance, or half the difference of the
distances to both pivots) is within the radius, and no others.  Gallery rows are
sent once for each helping of visitors that their block has.

On vectors without clusters the triangle inequality rules hardly anything out, and
queries would be sent to nearly every block.  A sample of the queries tells so
beforehand: then whole packs of queries meet whole packs of rows (packs.py), which
are kept once and never dealt by pairs.

To the driver come the pivots and one row for each pivot and ring width; both are
bounded by parameters here, not by the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packs

#: Bytes of queries that may be sent to blocks whatever they come to, and how many times each may be sent beyond that;
#: queries of the sample that tells.
SPARE, VISITS, SAMPLE = 256 << 20, 4, 256
#: Pivots at most, widths of the rings of a cell, and what rounding may take from a lower bound.
MOST_PIVOTS, WIDTHS, ROUNDING = 512, 256, 1e-6
KEPT = "block int, vec_id long, embedding array<double>"
ASKED = "block int, part int, query_id long, embedding array<double>"
HITS = "query_id long, vec_id long, d2 double"


def matrix(values) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in values], np.float64)


def squared(q: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of q and g."""
    return np.maximum((q * q).sum(1)[:, None] + (g * g).sum(1)[None, :] - 2 * q @ g.T, 0)


@dataclass
class Layout:
    """Pivots, and of each block its cell, the least and largest distance to the pivot, and its rows."""

    pivots: np.ndarray
    width: float
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    first: np.ndarray  # by cell and width: the first block
    salts: np.ndarray  # by cell and width: how many blocks share the rows

    def place(self, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The block of each gallery row."""
        cell, level, _ = nearest_pivot(vectors, self.pivots, self.width)
        return self.first[cell, level] + ids % self.salts[cell, level]

    def lower(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and block: what no distance is below, and what all distances are within."""
        d = np.sqrt(squared(vectors, self.pivots))
        own, near = d[:, self.cell], d.min(1, keepdims=True)
        low = np.maximum.reduce([own - self.high, self.low - own, (own - near) / 2, np.zeros_like(own)])
        return np.maximum(low - ROUNDING * (1 + own), 0), own + self.high + ROUNDING * (1 + own)


def nearest_pivot(vectors: np.ndarray, pivots: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell, ring width number and distance of each vector."""
    d2 = squared(vectors, pivots)
    cell = d2.argmin(1)
    d = np.sqrt(d2[np.arange(len(d2)), cell])
    return cell, np.minimum(d / width, WIDTHS - 1).astype(np.int64), d


def layout(gallery: DataFrame, rows: int, block: int) -> Layout:
    """How a gallery(vec_id, embedding) of so many rows is laid out in blocks of about `block` rows."""
    spark = gallery.sparkSession
    wanted = min(MOST_PIVOTS, max(4, 4 * -(-rows // block)))
    # Twice as many as wanted lie below the hash limit, so that hardly ever too few do; the least hashes are taken.
    limit = -(2**63) + 2**64 * min(rows, 2 * wanted + 32) // rows
    drawn = gallery.select(F.xxhash64("vec_id").alias("h"), "vec_id", "embedding").where(F.col("h") <= min(limit, 2**63 - 1)).orderBy("h", "vec_id").limit(wanted).collect()
    if not drawn:  # one hash for all rows
        drawn = gallery.select("vec_id", "embedding").limit(wanted).collect()
    pivots = np.unique(matrix(r["embedding"] for r in drawn), axis=0)
    apart = np.sqrt(squared(pivots, pivots) + np.diag(np.full(len(pivots), np.inf))).min(1)
    width = float(np.median(apart[np.isfinite(apart)])) / (WIDTHS // 4) if len(pivots) > 1 else 1.0
    width = width or 1.0
    shared = spark.sparkContext.broadcast(pivots)  # MOST_PIVOTS at most

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cell, level, d = nearest_pivot(matrix(b["embedding"]), shared.value, width)
                yield pd.DataFrame({"cell": cell, "level": level, "d": d}).groupby(["cell", "level"])["d"].agg(["size", "min", "max"]).reset_index()

    sums = gallery.select("embedding").mapInPandas(measure, "cell int, level int, size long, min double, max double")
    found = sums.groupBy("cell", "level").agg(F.sum("size").alias("n"), F.min("min").alias("low"), F.max("max").alias("high")).collect()  # MOST_PIVOTS * WIDTHS rows at most
    first, salts = np.zeros((len(pivots), WIDTHS), np.int64), np.ones((len(pivots), WIDTHS), np.int64)
    blocks: list[list] = []  # cell, low, high, rows
    open_: list | None = None  # a ring that takes in further widths
    for r in sorted(found, key=lambda r: (r["cell"], r["level"])):
        at = r["cell"], r["level"]
        if r["n"] > block:
            n = -(-r["n"] // block)
            first[at], salts[at], open_ = len(blocks), n, None
            blocks += [[r["cell"], r["low"], r["high"], r["n"] // n] for _ in range(n)]
        elif open_ and open_[0] == r["cell"] and open_[3] + r["n"] <= block:
            open_[2], open_[3] = r["high"], open_[3] + r["n"]
            first[at] = len(blocks) - 1
        else:
            open_ = [r["cell"], r["low"], r["high"], r["n"]]
            first[at] = len(blocks)
            blocks.append(open_)
    cell, low, high, count = (np.array(x) for x in zip(*blocks, strict=True))
    return Layout(pivots, width, cell, low, high, count, first, salts)


def _ask(queries: DataFrame, plan, k: int, home: bool, parts=None) -> DataFrame:
    """A row for each query and block that it looks into: its nearest block only, or all within its radius."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = plan.value
        enough = of.rows // 2 > k  # salted blocks are of like size, not of equal size
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                vectors = matrix(part["embedding"])
                low, high = of.lower(vectors)
                if home:
                    row, block = np.arange(len(part)), np.lexsort((high, low), axis=1)[:, 0]
                else:
                    # leave_out_self takes one row away, so blocks of more than k rows are asked for.
                    bound = np.where(enough, high, np.inf).min(1)
                    radius = np.minimum(bound, np.sqrt(part["radius2"].to_numpy()) * (1 + ROUNDING) + ROUNDING)
                    row, block = np.nonzero(low <= radius[:, None])
                ids = part["query_id"].to_numpy()[row]
                share = np.zeros(len(row), np.int64) if parts is None else ids % parts.value[block]
                yield pd.DataFrame({"block": block, "part": share, "query_id": ids, "embedding": list(vectors[row])})

    return queries.mapInPandas(run, ASKED)


def _place(gallery: DataFrame, plan, parts=None) -> DataFrame:
    """The gallery's rows with their block, once for each part of its visitors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                ids = b["vec_id"].to_numpy()
                yield pd.DataFrame({"block": plan.value.place(matrix(b["embedding"]), ids), "vec_id": ids, "embedding": b["embedding"].to_numpy()})

    rows = gallery.mapInPandas(run, KEPT)
    if parts is None:
        return rows.withColumn("part", F.lit(0))
    copies = gallery.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(parts.value)], "block int, parts int").where("parts > 0")
    return rows.join(F.broadcast(copies), "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def with_radius(queries: DataFrame, gallery: DataFrame, plan, k: int, nearest, leave_out_self: bool) -> DataFrame:
    """The queries with the squared distance of the k-th row of their nearest block, infinite where that has fewer."""

    def meet(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        return _meet(q, g, k, nearest, leave_out_self)

    first = _ask(queries, plan, k, True).groupBy("block").cogroup(_place(gallery, plan).groupBy("block")).applyInPandas(meet, HITS)
    far = first.groupBy("query_id").agg(F.max("d2").alias("radius2"), F.count("*").alias("n"))
    radius = F.when(F.col("n") >= k, F.col("radius2")).otherwise(float("inf"))
    asked = queries.join(far, "query_id", "left").select("query_id", "embedding", F.coalesce(radius, F.lit(float("inf"))).alias("radius2"))
    # It is read twice; a shared folder, where there is one, keeps the first round from running again.
    return asked.checkpoint() if queries.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else asked


def _meet(q: pd.DataFrame, g: pd.DataFrame, k: int, nearest, leave_out_self: bool) -> pd.DataFrame:
    out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "d2": np.zeros(0)})]
    if len(q) and len(g):
        m, ids = matrix(g["embedding"]), g["vec_id"].to_numpy()
        for at in range(0, len(q), 512):
            part = q.iloc[at : at + 512]
            asked = part["query_id"].to_numpy()
            row, hit, dist = nearest(matrix(part["embedding"]), m, ids, asked if leave_out_self else None, k)
            out.append(pd.DataFrame({"query_id": asked[row], "vec_id": hit, "d2": dist}))
    return pd.concat(out)


def search(queries: DataFrame, gallery: DataFrame, rows: int, k: int, block: int, nearest, leave_out_self: bool = False) -> tuple[DataFrame, dict]:
    """query_id, vec_id and d2 of at least the k nearest rows of each query; and how many of all (query, block) pairs were visited (all of them by packs).

    queries(query_id, embedding) and gallery(vec_id, embedding) of doubles; rows:
    the gallery's.  nearest: the search within a block.  A query_id that occurs
    more than once is asked as often, which must be with one vector.
    """
    spark: SparkSession = gallery.sparkSession
    made = layout(gallery, rows, block)
    n, wide = queries.count(), made.pivots.shape[1]
    if _visits(queries, n, gallery, made, k, leave_out_self) * n * wide * 8 > max(SPARE, VISITS * n * wide * 8):
        return packs.nearest(queries, n, gallery, rows, wide, k, 2 * block, leave_out_self), {"visited": n * len(made.cell), "blocks": len(made.cell)}
    plan = spark.sparkContext.broadcast(made)
    asked = with_radius(queries, gallery, plan, k, nearest, leave_out_self)
    counts = {r["block"]: r["n"] for r in _ask(asked, plan, k, False).groupBy("block").agg(F.count("*").alias("n")).collect()}  # a row a block
    parts = spark.sparkContext.broadcast(np.array([-(-counts.get(b, 0) // (4 * block)) for b in range(len(made.cell))]))

    def meet(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        return _meet(q, g, k, nearest, leave_out_self)

    both = _ask(asked, plan, k, False, parts).groupBy("block", "part").cogroup(_place(gallery, plan, parts).groupBy("block", "part"))
    return both.applyInPandas(meet, HITS), {"visited": sum(counts.values()), "blocks": len(made.cell)}


def _visits(queries: DataFrame, n: int, gallery: DataFrame, made: Layout, k: int, leave_out_self: bool) -> float:
    """How many blocks a query has to look into at least, on the average of a sample."""
    limit = -(2**63) + 2**64 * min(n, 2 * SAMPLE) // max(n, 1)
    drawn = queries.where(F.xxhash64("query_id") <= min(limit, 2**63 - 1)).limit(SAMPLE).collect()
    if not drawn:
        return 0.0
    ids, vectors = np.array([r["query_id"] for r in drawn]), matrix(r["embedding"] for r in drawn)
    shared = gallery.sparkSession.sparkContext.broadcast((ids, vectors))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, v = shared.value
        best = np.full((len(asked), k), np.inf)
        for b in batches:
            for at in range(0, len(b), 4096):
                part = b.iloc[at : at + 4096]
                d2 = squared(v, matrix(part["embedding"]))
                if leave_out_self:
                    d2[asked[:, None] == part["vec_id"].to_numpy()[None, :]] = np.inf
                best = np.partition(np.hstack([best, d2]), k - 1, axis=1)[:, :k]
        yield pd.DataFrame({"best": [best.tobytes()]})

    found = [np.frombuffer(r["best"]).reshape(len(drawn), k) for r in gallery.mapInPandas(run, "best binary").collect()]  # a row a task
    radius = np.sqrt(np.sort(np.hstack(found), axis=1)[:, k - 1])
    low, _ = made.lower(vectors)
    return float((low <= radius[:, None]).sum(1).mean())


def earliest_within(queries: DataFrame, gallery: DataFrame, rows: int, near, block: int) -> DataFrame:
    """query_id and vec_id: of each query the smallest smaller id among the gallery rows that `near` accepts, if there is one.

    near: a radius and a test of squared distances, which holds for none beyond the
    radius.  Blocks give one row a query at most, however many rows are near.
    """
    radius, test = near
    plan = gallery.sparkSession.sparkContext.broadcast(layout(gallery, rows, block))
    asked = queries.select("query_id", "embedding", F.lit(float(radius * radius)).alias("radius2"))
    counts = {r["block"]: r["n"] for r in _ask(asked, plan, rows, False).groupBy("block").agg(F.count("*").alias("n")).collect()}  # a row a block
    parts = gallery.sparkSession.sparkContext.broadcast(np.array([-(-counts.get(b, 0) // (4 * block)) for b in range(len(plan.value.cell))]))

    def meet(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(g):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64)})
        return earliest(q["query_id"].to_numpy(), matrix(q["embedding"]), g["vec_id"].to_numpy(), matrix(g["embedding"]), test)

    both = _ask(asked, plan, rows, False, parts).groupBy("block", "part").cogroup(_place(gallery, plan, parts).groupBy("block", "part"))
    return both.applyInPandas(meet, "query_id long, vec_id long").groupBy("query_id").agg(F.min("vec_id").alias("vec_id"))


def earliest(asked: np.ndarray, vectors: np.ndarray, ids: np.ndarray, gallery: np.ndarray, test) -> pd.DataFrame:
    """For queries held against rows in one task: the smallest smaller id that is near."""
    out = []
    for at in range(0, len(asked), 512):
        own = asked[at : at + 512]
        near = test(squared(vectors[at : at + 512], gallery)) & (ids[None, :] < own[:, None])
        first = np.where(near, ids[None, :], np.iinfo(np.int64).max).min(1)
        out.append(pd.DataFrame({"query_id": own, "vec_id": first})[first < np.iinfo(np.int64).max])
    return pd.concat(out)
