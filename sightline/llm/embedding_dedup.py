"""Near-deduplication of embeddings with randomised-rotation binary codes.

A unit vector is rotated at random; its code is the signs of the rotated
coordinates, and the stored correction factor is the inner product f of the
vector with its code's direction.  For a second vector q, <code, q'> / f is an
unbiased estimate of the cosine c; its error is sqrt(1 - c^2) * sqrt(1 - f^2) / f
times a coordinate of a random direction.  A pair whose estimate lies below the
limit by more than the confidence bound cannot be linked; only the others are
computed anew, in double precision.

All pairs are covered, whatever their labels.  Vectors fall into cells around
pivots; two cells whose angular distance exceeds their radii and the limit
together are skipped, which the triangle inequality makes exact.  Cells are
split into blocks of bounded size, and a task gets two blocks.  It returns link
counts and a spanning forest of its links, never the pairs of a group, so a
group of near copies costs no more than its rows.  Equal vectors are one
representative with a count first.

Vectors that are null, empty, zero, or hold null or non-finite components link
with nothing.  Vectors of different length do not link.  A null vec_id links
with nothing and has no component.  Rows repeated under one vec_id count as
copies.  Long vectors make blocks of fewer rows.  An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, lean, materialize, tasks

#: Bytes of vectors in a block, in double precision; pivots at most; deviations of the bound.
BLOCK_BYTES, MOST_PIVOTS, SIGMAS = 8 << 20, 1024, 6.0
#: Pairs whose estimates are held at a time.
STRIP = 1 << 20


def rotation(size: int) -> np.ndarray:
    """A random orthogonal matrix, the same for each size."""
    q, r = np.linalg.qr(np.random.default_rng(1000 + size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def padded(size: int) -> int:
    """Length of codes: at least 64 and a multiple of 8."""
    return max(64, -(-size // 8) * 8)


def rotate(x: np.ndarray) -> np.ndarray:
    """Rows of x, filled up with zeros, in rotated coordinates."""
    d = padded(x.shape[1])
    return np.pad(x, ((0, 0), (0, d - x.shape[1]))) @ rotation(d)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign codes of unit rows, and their correction factors."""
    r = rotate(x)
    return np.packbits(r > 0, axis=1), np.abs(r).sum(1) / np.sqrt(r.shape[1])


def signs(codes: np.ndarray) -> np.ndarray:
    """Directions of packed codes, as unit vectors."""
    bits = np.unpackbits(codes, axis=1).astype(np.float32)
    return (2 * bits - 1) / np.float32(np.sqrt(bits.shape[1]))


def slack(factor: np.ndarray, limit: float, size: int) -> np.ndarray:
    """How far below the limit an estimate may lie when the cosine reaches the limit."""
    return np.sqrt(1 - limit * limit) * np.sqrt(np.maximum(0, 1 - factor**2)) / factor * min(1.0, SIGMAS / np.sqrt(size - 1)) + 1e-4


def unit(values) -> np.ndarray | None:
    """The vector at length 1 in double precision, or None where it links with nothing."""
    if values is None:
        return None
    x = np.asarray(values, np.float64)
    if not len(x) or not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top
    return x / np.sqrt((x * x).sum())


def prepared(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id, set_key (null where nothing links), size, vector (unit, double), code and factor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            units = [unit(v) for v in b["v"]]
            rows = [(None, 0, None, None, None)] * len(units)
            by: dict[int, list[int]] = {}
            for i, u in enumerate(units):
                if u is not None:
                    by.setdefault(len(u), []).append(i)
            for size, at in by.items():
                x = np.stack([units[i] for i in at])
                codes, factor = encode(x)
                for k, i in enumerate(at):
                    data = x[k].tobytes()
                    rows[i] = (hashlib.blake2b(data, digest_size=16).digest(), size, data, codes[k].tobytes(), float(factor[k]))
            yield pd.DataFrame(rows, columns=["set_key", "size", "vector", "code", "factor"]).assign(id=b["id"].array)

    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v"))
    return rows.mapInPandas(lean(run), "set_key binary, size int, vector binary, code binary, factor double, id long")


def _links(x: dict, y: dict | None, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of two blocks as indices, or of one block with itself (i < j), some at a time."""
    same = y is None
    y = x if same else y
    q = rotate(y["vector"]).astype(np.float32)
    least = (limit - slack(x["factor"], limit, q.shape[1])).astype(np.float32) * x["factor"].astype(np.float32)
    direction = signs(x["code"])
    strip = max(1, STRIP // len(q))
    for at in range(0, len(direction), strip):
        i, j = np.nonzero(direction[at : at + strip] @ q.T >= least[at : at + strip, None])
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 50_000):
            a, b = i[k : k + 50_000], j[k : k + 50_000]
            ok = np.einsum("ij,ij->i", x["vector"][a], y["vector"][b]) >= limit
            if ok.any():
                yield a[ok], b[ok]


def summed(x: dict, y: dict | None, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two blocks, or one with itself: ids, how many rows each is linked with, and the least id that it reaches.

    Links are counted and joined to trees as they are found; no more than a strip of them is held.
    """
    parts = [x] if y is None else [x, y]
    ids, n = (np.concatenate([p[k] for p in parts]) for k in ("id", "n"))
    order = np.argsort(ids, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(ids))
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for a, b in _links(x, y, limit):
        b = b + (0 if y is None else len(x["id"]))
        # Weights are whole numbers below 2**53, so sums of them are exact.
        links += (np.bincount(a, weights=n[b], minlength=len(ids)) + np.bincount(b, weights=n[a], minlength=len(ids))).astype(np.int64)
        p, q = root[place[a]], root[place[b]]
        apart = p != q
        if apart.any():
            root = forest(p[apart], q[apart], len(ids))[root]
    return ids, links, ids[order][root][place]


def pivots_of(reps: DataFrame, wanted: int) -> dict[int, list[np.ndarray]]:
    """Of each vector length the `wanted` vectors with the least hash of their id; lengths are few.

    Hashes below a limit that some more than `wanted` rows pass come to the driver
    with their vectors, so nothing is sorted but these.
    """
    h = F.xxhash64("id")
    share = F.least(F.lit(1.0), F.lit(2.0 * wanted + 64) / F.col("rows"))
    bound = F.lit(float(-(2**63))) + share * float(2**64)
    counts = reps.groupBy("size").agg(F.count("*").alias("rows")).select("size", bound.alias("bound"))
    drawn = reps.select("size", "id", "vector", h.alias("h")).join(counts, "size").where(F.col("h").cast("double") <= F.col("bound")).select("size", "id", "vector", "h")
    out: dict[int, list[np.ndarray]] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["h"], r["id"])):
        out.setdefault(r["size"], []).append(np.frombuffer(r["vector"]))
    return {size: v[:wanted] for size, v in out.items()}


def near_groups(table: DataFrame, limit: float = 0.95, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = table.sparkSession
    rows = materialize(prepared(table, id_column, vector), "codes")
    reps = rows.where("set_key is not null and id is not null").groupBy("set_key").agg(F.min("id").alias("id"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("size", "vector", "code", "factor")))
    reps = materialize(reps, "vectors")
    total = reps.count()
    longest = reps.agg(F.coalesce(F.max("size"), F.lit(1))).first()[0]
    block_rows = max(16, BLOCK_BYTES // (8 * longest))
    wanted = min(MOST_PIVOTS, max(1, total // block_rows))
    pivots = {size: np.stack(sorted(v, key=lambda x: x.tolist())) for size, v in sorted(pivots_of(reps, wanted).items())}
    first_cell = dict(zip(pivots, np.cumsum([0, *map(len, pivots.values())]).tolist(), strict=False))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell, angle = np.zeros(len(b), np.int32), np.zeros(len(b))
            for size in b["size"].unique():
                at = np.flatnonzero(b["size"] == size)
                c = np.frombuffer(b"".join(b["vector"].iloc[at])).reshape(len(at), -1) @ pivots[size].T
                best = c.argmax(1)
                cell[at] = first_cell[size] + best
                angle[at] = np.arccos(np.clip(c[np.arange(len(at)), best], -1, 1))
            yield b[["id", "n", "vector", "code", "factor"]].assign(cell=cell, angle=angle)

    cells = materialize(reps.mapInPandas(lean(assign), "id long, n long, vector binary, code binary, factor double, cell int, angle double"), "cells")
    stats = {r["cell"]: r for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}  # a row per pivot
    blocks, count = {}, 0
    for c in sorted(stats):
        k = -(-stats[c]["n"] // block_rows)
        blocks[c] = (count, k)
        count += k
    near: dict[int, list[int]] = {c: [] for c in stats}
    theta = float(np.arccos(limit)) + 1e-9
    for size, p in pivots.items():
        own = [c for c in stats if first_cell[size] <= c < first_cell[size] + len(p)]
        apart = np.arccos(np.clip(p @ p.T, -1, 1))
        for c in own:
            near[c] = [d for d in own if c == d or apart[c - first_cell[size], d - first_cell[size]] <= stats[c]["radius"] + stats[d]["radius"] + theta + 1e-7]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each row once for every pair of blocks that its block is in."""
        for b in batches:
            salt = (b["id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for c in b["cell"].unique():
                at = np.flatnonzero(b["cell"] == c)
                start, k = blocks[c]
                block = start + (salt[at] % np.uint64(k)).astype(np.int64)
                for d in near[c]:
                    for other in range(blocks[d][0], sum(blocks[d])):
                        yield b.iloc[at].drop(columns=["cell", "angle"]).assign(bi=np.minimum(block, other), bj=np.maximum(block, other), side=(block > other).astype(np.int32))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def stream():
            for b in batches:
                yield from zip(b["bi"].tolist(), b["bj"].tolist(), b["side"].tolist(), b["id"].tolist(), b["n"].tolist(), b["vector"], b["code"], b["factor"].tolist(), strict=True)

        for (bi, bj), group in groupby(stream(), lambda r: r[:2]):
            group = list(group)
            parts = []
            for side in (0, 1):
                g = [r for r in group if r[2] == side]
                if g:
                    parts.append({"id": np.array([r[3] for r in g]), "n": np.array([r[4] for r in g]), "vector": np.stack([np.frombuffer(r[5]) for r in g]), "code": np.stack([np.frombuffer(r[6], np.uint8) for r in g]), "factor": np.array([r[7] for r in g])})
            if bi != bj and len(parts) < 2:
                continue
            ids, links, root = summed(parts[0], None if bi == bj else parts[1], limit)
            some = links > 0
            if some.any():
                yield pd.DataFrame({"id": ids[some], "links": links[some], "root": root[some]})

    dealt = cells.mapInPandas(lean(deal), "id long, n long, vector binary, code binary, factor double, bi long, bj long, side int")
    dealt = dealt.repartition(tasks(spark), "bi", "bj").sortWithinPartitions("bi", "bj", "side", "id")
    found = materialize(dealt.mapInPandas(lean(link), "id long, links long, root long"), "links")
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("id").agg(F.sum("links").alias("links")).join(groups, "id", "left")
    each = reps.select("set_key", "id", "n").join(linked, "id", "left").select("set_key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = rows.select(F.col("id").alias(id_column), F.when(F.col("id").isNotNull(), F.col("set_key")).alias("set_key")).join(each, "set_key", "left")
    out = out.select(id_column, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", id_column).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(False)))
