"""Retrieval metrics over ranked hits (query_id, rank, brand, true_brand, similarity)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import knn, similarity

#: Similarity thresholds of the sweep.
THRESHOLDS = [round(0.50 + 0.05 * i, 2) for i in range(10)]


def leave_one_out(vectors: DataFrame, k: int = 5) -> DataFrame:
    """Hits of every vector among all others, for brands with two vectors or more. vectors(vec_id, embedding, brand)."""
    brands = vectors.groupBy("brand").agg(F.count("*").alias("n")).where("n >= 2").select("brand")
    asked = vectors.join(brands, "brand", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding", F.col("brand").alias("true_brand"))
    return with_brands(knn(asked.select("query_id", "embedding"), vectors, k, leave_out_self=True), asked, vectors)


def against(asked: DataFrame, gallery: DataFrame, k: int = 5) -> DataFrame:
    """Hits of every query vector (query_id, embedding, true_brand) in another table (vec_id, embedding, brand)."""
    return with_brands(knn(asked.select("query_id", "embedding"), gallery, k), asked, gallery)


def with_brands(hits: DataFrame, asked: DataFrame, gallery: DataFrame) -> DataFrame:
    """Hits with the brand found, the true one, and the similarity."""
    named = hits.join(gallery.select("vec_id", "brand"), "vec_id").join(asked.select("query_id", "true_brand"), "query_id")
    return named.select("query_id", "rank", "vec_id", "brand", "true_brand", similarity(F.col("d2")).alias("similarity"))


def per_query(hits: DataFrame) -> DataFrame:
    """Rank of the first correct hit of each query, null without one."""
    return hits.groupBy("query_id", "true_brand").agg(F.min(F.when(F.col("brand") == F.col("true_brand"), F.col("rank"))).alias("first_hit"))


def recall(k: int):
    return F.coalesce(F.avg(F.when(F.col("first_hit") <= k, 1.0).otherwise(0.0)), F.lit(0.0))


def mrr():
    return F.coalesce(F.avg(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))), F.lit(0.0))


def summary(hits: DataFrame) -> DataFrame:
    """recall_at_1, recall_at_3, recall_at_5, mrr and n_queries."""
    return per_query(hits).agg(*(recall(k).alias(f"recall_at_{k}") for k in (1, 3, 5)), mrr().alias("mrr"), F.count("*").alias("n_queries"))


def by_brand(hits: DataFrame) -> DataFrame:
    """Mean recall at 1 of each true brand."""
    return per_query(hits).groupBy(F.col("true_brand").alias("brand")).agg(recall(1).alias("recall_at_1"), F.count("*").alias("n"))


def sweep(hits: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Recall at 1, MRR and coverage when only hits from a threshold on count; ranks are those among what remains.

    One pass: a hit is copied to the thresholds it reaches, and queries without
    hits are counted in by the total.
    """
    total = hits.agg(F.countDistinct("query_id").alias("total"))
    levels = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    kept = hits.select("*", levels).where("similarity >= threshold")
    # Hits come by descending similarity, so what remains is a prefix and keeps its ranks.
    each = kept.groupBy("threshold", "query_id").agg(F.min(F.when(F.col("brand") == F.col("true_brand"), F.col("rank"))).alias("first_hit"))
    sums = each.groupBy("threshold").agg(F.sum(F.when(F.col("first_hit") == 1, 1.0).otherwise(0.0)).alias("r"), F.sum(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))).alias("m"), F.count("*").alias("c"))
    every = hits.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    share = lambda c: F.coalesce(F.col(c) / F.col("total"), F.lit(0.0))
    return F.broadcast(every).join(sums, "threshold", "left").crossJoin(F.broadcast(total)).select("threshold", share("r").alias("recall_at_1"), share("m").alias("mrr"), share("c").alias("coverage"))


def brand_by_model(results: DataFrame, models: list[str]) -> DataFrame:
    """From results(model, brand, recall_at_1), a row per brand and a column per model, 0 where missing."""
    return results.groupBy("brand").pivot("model", models).agg(F.first("recall_at_1")).fillna(0.0)


def query_report(hits: DataFrame) -> DataFrame:
    """A row per query: first hit with both scores, brands of the first three and five joined by ';', recalls and reciprocal rank."""
    rows = hits.groupBy("query_id", "true_brand").agg(F.sort_array(F.collect_list(F.struct("rank", "brand", "similarity"))).alias("h"), F.min(F.when(F.col("brand") == F.col("true_brand"), F.col("rank"))).alias("first_hit"))
    names = F.transform("h", lambda x: x["brand"])
    flag = lambda k: F.when(F.col("first_hit") <= k, 1).otherwise(0).alias(f"recall_at_{k}")
    return rows.select("query_id", "true_brand", F.col("h")[0]["brand"].alias("rank1_brand"), F.round(F.col("h")[0]["similarity"], 4).alias("rank1_score"), F.round(2 * F.col("h")[0]["similarity"] - 1, 4).alias("rank1_cosine"), F.concat_ws(";", F.slice(names, 1, 3)).alias("rank3_brands"), F.concat_ws(";", F.slice(names, 1, 5)).alias("rank5_brands"), flag(1), flag(3), flag(5), F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("reciprocal_rank"))
