"""Suppression of overlapping boxes, rank metrics, and the clustering filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def suppress(x1, y1, x2, y2, score, limit: float) -> np.ndarray:
    """Which boxes stay: best first, each drops later ones that overlap it by more than `limit` (intersection over union)."""
    order = np.argsort(-score, kind="stable")
    area = np.maximum(0, x2 - x1) * np.maximum(0, y2 - y1)
    stay = np.ones(len(score), bool)
    for k, i in enumerate(order):
        if not stay[i]:
            continue
        rest = order[k + 1 :]
        w = np.maximum(0, np.minimum(x2[i], x2[rest]) - np.maximum(x1[i], x1[rest]))
        h = np.maximum(0, np.minimum(y2[i], y2[rest]) - np.maximum(y1[i], y1[rest]))
        union = area[i] + area[rest] - w * h
        stay[rest[(w * h > limit * union)]] = False
    return stay


def nms(boxes: DataFrame, key: list[str], order: list[str], limit: float = 0.3) -> DataFrame:
    """Boxes that stay within each group, whatever their labels; equal scores by `order`.

    A group is the boxes of one frame.  Rows are dealt and sorted by key and
    handed to Python as they come, so that many small groups cost no more than
    one large one.
    """
    rows = boxes.repartition(*key).sortWithinPartitions(*key, F.desc("score"), *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(part: pd.DataFrame) -> pd.DataFrame:
            group = part.groupby(key, sort=False, dropna=False).ngroup().to_numpy()
            edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            v = {c: part[c].to_numpy(np.float64) for c in ("x1", "y1", "x2", "y2", "score")}
            stay = np.concatenate([suppress(*(v[c][a:b] for c in ("x1", "y1", "x2", "y2", "score")), limit) for a, b in zip(edges, np.append(edges[1:], len(part)), strict=True)])
            return part[stay]

        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            last = b[key].iloc[-1] if len(b) else None
            open_ = ((b[key] == last) | (b[key].isna() & last.isna())).all(axis=1) if last is not None else pd.Series([], dtype=bool)
            held = b[open_]
            if len(done := b[~open_]):
                yield out(done)
        if held is not None and len(held):
            yield out(held)

    return rows.mapInPandas(run, boxes.schema)


def rank_metrics(logits: DataFrame, key: str, top: int = 6) -> DataFrame:
    """Five measures of POS against NEG prompts: logits(key, prompt, category, logit).

    logit_sum_diff: the `top` largest of each kind summed; rank_weighted: logits
    over ranks, POS by NEG; mean_rank_ratio: NEG by POS; top_ratio: POS by NEG
    among the `top` of all.
    """
    w = Window.partitionBy(key).orderBy(F.desc("logit"), "prompt")
    own = Window.partitionBy(key, "category").orderBy(F.desc("logit"), "prompt")
    r = logits.withColumn("rank", F.row_number().over(w)).withColumn("own", F.row_number().over(own))
    pos, neg = F.col("category") == "POS", F.col("category") == "NEG"
    total = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0.0))
    s = r.groupBy(key).agg(
        (total(pos & (F.col("own") <= top), F.col("logit")) - total(neg & (F.col("own") <= top), F.col("logit"))).alias("logit_sum_diff"),
        F.try_divide(total(pos, F.col("logit") / F.col("rank")), total(neg, F.col("logit") / F.col("rank"))).alias("rank_weighted"),
        (F.avg(F.when(neg, F.col("rank"))) / (F.avg(F.when(pos, F.col("rank"))) + 1e-6)).alias("mean_rank_ratio"),
        (total(pos & (F.col("rank") <= top), F.lit(1.0)) / (total(neg & (F.col("rank") <= top), F.lit(1.0)) + 1e-6)).alias("top_ratio"),
    )
    return s


def z_scores(rows: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Columns less their mean, over their sample deviation; null where that is 0."""
    stats = rows.groupBy(*by).agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    joined = rows.join(stats, list(by)) if by else rows.crossJoin(F.broadcast(stats))  # one row of statistics
    return joined.select(*(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")).alias(c) if c in columns else F.col(c) for c in rows.columns))


def cluster_filter(rows: DataFrame, columns: list[str], score: str, clusters: int = 3, seed: int = 42) -> DataFrame:
    """Rows outside the cluster with the lowest centre on the first principal component.

    The component points the way of `score`.  Columns without spread are left
    out; with fewer rows than clusters all stay.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    spread = rows.agg(*(F.stddev_samp(c).alias(c) for c in columns), F.count("*").alias("_n")).first()
    use = [c for c in columns if spread[c]]
    if not use or spread["_n"] < clusters:
        return rows.withColumn("component", F.lit(None).cast("double"))
    z = z_scores(rows.select("*", *(F.col(c).cast("double").alias(f"_z_{c}") for c in use)), [f"_z_{c}" for c in use]).fillna(0.0, [f"_z_{c}" for c in use])
    v = VectorAssembler(inputCols=[f"_z_{c}" for c in use], outputCol="_v").transform(z)
    p = PCA(k=1, inputCol="_v", outputCol="_p").fit(v).transform(v).withColumn("component", vector_to_array("_p")[0])
    sign = p.agg(F.corr("component", F.col(score).cast("double"))).first()[0]
    p = p.withColumn("component", F.col("component") * (-1.0 if sign is not None and sign < 0 else 1.0))
    k = VectorAssembler(inputCols=["component"], outputCol="_c").transform(p)
    model = KMeans(k=clusters, seed=seed, featuresCol="_c", predictionCol="_k").fit(k)
    lowest = int(np.argmin([c[0] for c in model.clusterCenters()]))
    return model.transform(k).where(F.col("_k") != lowest).select(*rows.columns, "component")
