"""Exact nearest neighbours and what is built on them.

A gallery whose size has been checked is broadcast as one matrix; a larger one
is laid out in blocks around pivots, and each query visits the blocks that can
hold one of its nearest rows (metric_index).  Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metric_index as M
from .ordinals import numbered

#: Largest gallery, in bytes of double precision, that is sent to every task; and rows of a block otherwise.
BROADCAST_BYTES, BLOCK = 64 << 20, 8192
HITS = "query_id long, vec_id long, d2 double"


def _nearest(q: np.ndarray, g: np.ndarray, gid: np.ndarray, own: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row in q, id and squared distance of the k nearest rows of g, by (distance, id); own: ids to leave out."""
    d2 = M.squared(q, g)
    if own is not None:
        d2[own[:, None] == gid[None, :]] = np.inf
    if k < len(gid):  # keep everything as near as the k-th, so that ties are broken by id
        edge = np.partition(d2, k - 1, axis=1)[:, k - 1]
        row, col = np.nonzero(d2 <= edge[:, None])
    else:
        row, col = np.nonzero(d2 < np.inf)
    dist = d2[row, col]
    order = np.lexsort((gid[col], dist, row))
    row, col, dist = row[order], col[order], dist[order]
    keep = (np.arange(len(row)) - np.searchsorted(row, row, side="left") < k) & (dist < np.inf)
    return row[keep], gid[col[keep]], dist[keep]


def knn(queries: DataFrame, gallery: DataFrame, k: int, leave_out_self: bool = False) -> DataFrame:
    """query_id, vec_id, d2 and rank of the k nearest gallery rows of each query.

    queries(query_id, embedding), gallery(vec_id, embedding); vectors of one length, without nulls.
    """
    spark = gallery.sparkSession
    g = gallery.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    q = queries.where("query_id is not null and embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    bytes_ = g.agg(F.coalesce(F.sum(F.size("embedding") * 8), F.lit(0))).first()[0]
    if bytes_ <= BROADCAST_BYTES:
        rows = g.collect()  # checked above
        if not rows:
            return spark.createDataFrame([], HITS + ", rank int")
        shared = spark.sparkContext.broadcast((M.matrix(r["embedding"] for r in rows), np.array([r["vec_id"] for r in rows])))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m, ids = shared.value
            for b in batches:
                for at in range(0, len(b), 512):
                    part = b.iloc[at : at + 512]
                    own = part["query_id"].to_numpy() if leave_out_self else None
                    row, hit, dist = _nearest(M.matrix(part["embedding"]), m, ids, own, k)
                    yield pd.DataFrame({"query_id": part["query_id"].to_numpy()[row], "vec_id": hit, "d2": dist})

        found = q.mapInPandas(search, HITS)
    else:
        found, _ = M.search(q, g, g.count(), k, BLOCK, _nearest, leave_out_self)
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "vec_id"))
    return found.withColumn("rank", turn).where(F.col("rank") <= k)


def knn_expressions(queries: DataFrame, gallery: DataFrame, k: int, leave_out_self: bool = False) -> DataFrame:
    """The same by plain expressions; a cross-check for small inputs."""
    g = gallery.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = queries.select("query_id", F.col("embedding").cast("array<double>").alias("q"))
    d2 = F.aggregate(F.zip_with("q", "v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    pairs = q.join(g, F.col("query_id") != F.col("vec_id")) if leave_out_self else q.crossJoin(g)
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "vec_id"))
    return pairs.select("query_id", "vec_id", d2.alias("d2")).withColumn("rank", turn).where(F.col("rank") <= k)


def similarity(d2: Column) -> Column:
    """Half of one plus the cosine, for unit vectors."""
    return 1.0 - d2 / 4.0


def cosine(d2: Column) -> Column:
    return 1.0 - d2 / 2.0


def normalized(v: Column) -> Column:
    """The vector at length 1; a length below 1e-12 counts as that."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(d, lambda x: x / F.greatest(norm, F.lit(1e-12)))


def hybrid(a: Column, b: Column) -> Column:
    """Two embeddings end to end, at length 1."""
    return normalized(F.concat(a.cast("array<double>"), b.cast("array<double>")))


def mean_vectors(variants: DataFrame, key: str) -> DataFrame:
    """key and the mean of its variants' unit vectors, at length 1."""
    each = variants.select(key, F.posexplode(normalized(F.col("embedding"))).alias("pos", "x"))
    mean = each.groupBy(key, "pos").agg(F.avg("x").alias("x"))
    whole = mean.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("s"))
    return whole.select(key, normalized(F.transform("s", lambda s: s["x"])).alias("embedding"))


def top_by_brand(hits: DataFrame, k: int) -> DataFrame:
    """From hits(query_id, brand, similarity), the best similarity of each brand, rounded to four places, and the k best brands."""
    best = hits.groupBy("query_id", "brand").agg(F.max("similarity").alias("similarity")).withColumn("similarity", F.bround("similarity", 4))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "brand"))
    return best.withColumn("rank", turn).where(F.col("rank") <= k)


def consensus(hits: DataFrame, top: int = 5) -> DataFrame:
    """From hits(query_id, rank, brand), the commonest lower-case name of the first `top`: winner, votes, share; the first seen wins a tie."""
    names = hits.where(F.col("rank") <= top).groupBy("query_id", F.lower("brand").alias("winner")).agg(F.count("*").alias("votes"), F.min("rank").alias("first"))
    w = Window.partitionBy("query_id")
    ranked = names.withColumn("share", F.col("votes") / F.sum("votes").over(w)).withColumn("turn", F.row_number().over(w.orderBy(F.desc("votes"), "first")))
    return ranked.where("turn = 1").select("query_id", "winner", "votes", "share")


def zero_shot(logits: DataFrame, least: float = 0.8) -> DataFrame:
    """From logits(image, prompt, logit), the likeliest prompt by softmax, or null where it stays below `least`."""
    top = logits.groupBy("image").agg(F.max("logit").alias("top"), F.max_by("prompt", F.struct("logit", "prompt")).alias("best"))
    p = logits.join(top, "image").groupBy("image").agg(F.first("best").alias("best"), (1.0 / F.sum(F.exp(F.col("logit") - F.col("top")))).alias("probability"))
    return p.select("image", F.when(F.col("probability") >= least, F.col("best")).alias("prompt"), "probability")


def skip_near(new: DataFrame, gallery: DataFrame, limit: float | None = None, within: bool = False) -> DataFrame:
    """Rows of new(vec_id, embedding, ...) to be added: all of them, or with a limit those whose nearest gallery row is less similar.

    within: rows are added one after the other by vec_id, so one that is as similar
    to a row added before it is left out as well (insert_in_order).
    """
    if limit is None:
        return new
    near = knn(new.withColumnRenamed("vec_id", "query_id"), gallery, 1).where(similarity(F.col("d2")) >= limit)
    out = new.join(near.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    return insert_in_order(out, limit) if within else out


def _kept(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared folder where there is one."""
    return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df


def insert_in_order(new: DataFrame, limit: float) -> DataFrame:
    """Rows of new(vec_id, embedding, ...) that are added if each is left out when one added before it is at least as similar as `limit`.

    In steps: the first undecided rows are gone through in order by one task, BLOCK of
    them and then up to 16 times as many; then all later rows that are near an added one
    are left out, wherever they lie.  So rows are compared with added rows only, and the
    fewer remain, the more rows have near ones.  Rows with a null id or embedding are left out.
    """
    left = _kept(new.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")))
    radius = 2.0 * np.sqrt(max(0.0, 1.0 - limit)) + 1e-6
    test = lambda d2: 1.0 - d2 / 4.0 >= limit
    n, bytes_ = left.agg(F.count("*"), F.coalesce(F.sum(F.size("embedding") * 8), F.lit(0))).first()
    most = max(BLOCK, min(16 * BLOCK, BROADCAST_BYTES // max(1, bytes_ // max(1, n))))
    added, size = [], BLOCK
    while n:
        # Wherever the cut lies the result is the same; equal ids are not parted.
        cut = left.agg(F.percentile_approx("vec_id", size / n, 10_000)).first()[0] if n > size else None
        head = left if cut is None else left.where(F.col("vec_id") <= cut)
        in_ = _kept(head.coalesce(1).mapInPandas(_in_order(test), "vec_id long, embedding array<double>"))
        added.append(in_.select("vec_id"))
        if cut is None:
            break
        left = _kept(_without_near(left.where(F.col("vec_id") > cut), in_, radius, test))
        n, size = left.count(), min(2 * size, most)
    ids = reduce(DataFrame.unionByName, added) if added else left.select("vec_id")
    return new.join(ids, "vec_id", "left_semi")


def _in_order(test):
    """Of the rows in one task, those that are added one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        ids = np.concatenate([b["vec_id"].to_numpy() for b in held])
        v = np.concatenate([M.matrix(b["embedding"]) for b in held])
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        kept, n = np.zeros(len(ids), np.int64), 0  # places of added rows
        for at in range(0, len(ids), 512):
            part = np.arange(at, min(at + 512, len(ids)))
            for k in range(0, n, 8192):
                own = kept[k : min(k + 8192, n)]
                part = part[~(test(M.squared(v[part], v[own])) & (ids[own][None, :] < ids[part][:, None])).any(1)]
            near = test(M.squared(v[part], v[part])) & (ids[part][None, :] < ids[part][:, None])
            in_ = np.zeros(len(part), bool)
            for i in range(len(part)):
                in_[i] = not (near[i] & in_).any()
            kept[n : n + in_.sum()] = part[in_]
            n += in_.sum()
        for at in range(0, n, 1000):
            own = kept[at : min(at + 1000, n)]
            yield pd.DataFrame({"vec_id": ids[own], "embedding": list(v[own])})

    return run


def _without_near(queries: DataFrame, rows: DataFrame, radius: float, test) -> DataFrame:
    """Queries (vec_id, embedding) that no row before them is near."""
    n, bytes_ = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("embedding") * 8), F.lit(0))).first()
    if bytes_ > BROADCAST_BYTES:
        return queries.join(_earliest_near(queries, rows, n, radius, test), "vec_id", "left_anti")
    held = rows.collect()  # checked above
    if not held:
        return queries
    shared = rows.sparkSession.sparkContext.broadcast((np.array([r["vec_id"] for r in held]), M.matrix(r["embedding"] for r in held)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, g = shared.value
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at : at + 512]
                for k in range(0, len(ids), 8192):
                    if len(part):
                        near = test(M.squared(M.matrix(part["embedding"]), g[k : k + 8192])) & (ids[None, k : k + 8192] < part["vec_id"].to_numpy()[:, None])
                        part = part[~near.any(1)]
                yield part

    return queries.mapInPandas(run, "vec_id long, embedding array<double>")


def _earliest_near(queries: DataFrame, rows: DataFrame, n: int, radius: float, test) -> DataFrame:
    """vec_id of queries that have a near row before them, and the first such row as `before`."""
    q = queries.withColumnRenamed("vec_id", "query_id")
    bytes_ = rows.agg(F.coalesce(F.sum(F.size("embedding") * 8), F.lit(0))).first()[0]
    if bytes_ <= BROADCAST_BYTES:
        held = rows.collect()  # checked above
        if not held:
            return queries.select("vec_id", F.lit(None).cast("long").alias("before")).limit(0)
        shared = rows.sparkSession.sparkContext.broadcast((np.array([r["vec_id"] for r in held]), M.matrix(r["embedding"] for r in held)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield M.earliest(b["query_id"].to_numpy(), M.matrix(b["embedding"]), *shared.value, test)

        found = q.mapInPandas(run, "query_id long, vec_id long")
    else:
        found = M.earliest_within(q, rows, n, (radius, test), BLOCK)
    return found.select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("before"))


def number_from(gallery: DataFrame, new: DataFrame, order: list[str], copies: int = 1) -> DataFrame:
    """New rows with the ids that follow the gallery's, each `copies` times; `order` fixes who comes first."""
    highest = gallery.agg(F.coalesce(F.max("vec_id"), F.lit(-1)).alias("m"))
    rows = new.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    rows = numbered(rows, [*order, "copy"], "_n").crossJoin(F.broadcast(highest))  # one row
    return rows.withColumn("vec_id", F.col("m") + 1 + F.col("_n")).drop("m", "_n")


def by_space(queries: dict[str, DataFrame], galleries: dict[str, DataFrame], k: int, leave_out_self: bool = False) -> DataFrame:
    """Each embedding space searched by itself, results tagged with its name."""
    return reduce(DataFrame.unionByName, [knn(queries[s], galleries[s], k, leave_out_self).withColumn("space", F.lit(s)) for s in sorted(queries)])
