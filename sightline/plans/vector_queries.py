"""Vector search and retrieval metrics over `embeddings`.

Thresholds are scaled to the table; the operators keep their own defaults.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import vectors as V
from .base import query, table

LOO = """n AS (SELECT brand FROM [vectors] GROUP BY brand HAVING count(*) >= 2),
    h AS (SELECT query_id, vec_id, brand, true_brand, d2, 1 - d2 / 4 AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) AS rank FROM
        (SELECT q.vec_id AS query_id, g.vec_id AS vec_id, g.brand AS brand, q.brand AS true_brand, pow(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(g.embedding AS DOUBLE[])), 2) AS d2
         FROM [vectors] q JOIN [vectors] g ON q.vec_id <> g.vec_id WHERE q.brand IN (SELECT brand FROM n)) QUALIFY rank <= 5),
    f AS (SELECT query_id, true_brand, min(CASE WHEN brand = true_brand THEN rank END) AS first_hit FROM h GROUP BY ALL)"""
SUMS = "round(avg(CASE WHEN first_hit <= 1 THEN 1e0 ELSE 0 END), 6) AS recall_at_1, round(avg(CASE WHEN first_hit <= 3 THEN 1e0 ELSE 0 END), 6) AS recall_at_3, round(avg(CASE WHEN first_hit <= 5 THEN 1e0 ELSE 0 END), 6) AS recall_at_5, round(avg(coalesce(1e0 / first_hit, 0)), 6) AS mrr, count(*) AS n_queries"
OTHERS = """h AS (SELECT query_id, vec_id, brand, true_brand, d2, 1 - d2 / 4 AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) AS rank FROM
        (SELECT q.vec_id AS query_id, g.vec_id AS vec_id, g.brand AS brand, q.brand AS true_brand, pow(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(g.embedding AS DOUBLE[])), 2) AS d2
         FROM [vectors] q JOIN [vectors] g ON q.vec_id <> g.vec_id) QUALIFY rank <= {K})"""


def _loo(spark, sf):
    return R.leave_one_out(table(spark, sf, "vectors"))


def _rounded(df, *names):
    return df.select(*(F.round(c, 6).alias(c) if c in names else c for c in df.columns))


def _others(spark, sf, k):
    """Every vector asked against all others."""
    v = table(spark, sf, "vectors")
    asked = v.select(F.col("vec_id").alias("query_id"), "embedding", F.col("brand").alias("true_brand"))
    return R.with_brands(V.knn(asked.select("query_id", "embedding"), v, k, leave_out_self=True), asked, v)


@query(f"WITH {LOO} SELECT {SUMS}, (SELECT count(*) FROM [vectors]) - count(*) AS n_skipped FROM f")
def loo_recall_mrr(spark, sf):
    s = R.summary(_loo(spark, sf))
    total = table(spark, sf, "vectors").agg(F.count("*").alias("total"))
    return _rounded(s.crossJoin(F.broadcast(total)).withColumn("n_skipped", F.col("total") - F.col("n_queries")).drop("total"), "recall_at_1", "recall_at_3", "recall_at_5", "mrr")


@query(f"WITH {LOO} SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(similarity, 6) AS similarity, round(1 - d2 / 2, 6) AS cosine FROM h")
def knn_topk(spark, sf):
    v = table(spark, sf, "vectors")
    h = V.knn(v.select(F.col("vec_id").alias("query_id"), "embedding"), v, 5, leave_out_self=True)
    return h.select("query_id", "rank", "vec_id", F.round(V.similarity(F.col("d2")), 6).alias("similarity"), F.round(V.cosine(F.col("d2")), 6).alias("cosine"))


@query(f"WITH {OTHERS.replace('{K}', '5')} SELECT query_id, vec_id, brand, round(similarity, 6) AS similarity FROM h WHERE similarity >= 0.68")
def knn_threshold(spark, sf):
    h = _others(spark, sf, 5).where("similarity >= 0.68")
    return h.select("query_id", "vec_id", "brand", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {OTHERS.replace('{K}', '15')}, b AS (SELECT query_id, brand, round(max(similarity), 4) AS similarity FROM h GROUP BY ALL)
    SELECT query_id, brand, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, brand) AS INT) AS rank FROM b QUALIFY rank <= 5""")
def knn_brand_dedup(spark, sf):
    return V.top_by_brand(_others(spark, sf, 15), 5)


@query(f"""WITH {OTHERS.replace('{K}', '5')}, c AS (SELECT query_id, lower(brand) AS winner, count(*) AS votes, min(rank) AS first FROM h GROUP BY ALL)
    SELECT query_id, winner, votes, votes / 5e0 AS share FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, first) = 1""")
def knn_consensus(spark, sf):
    return V.consensus(_others(spark, sf, 5))


@query(f"""WITH {LOO}, t AS (SELECT unnest([0.5e0, 0.55e0, 0.6e0, 0.65e0, 0.7e0, 0.75e0, 0.8e0, 0.85e0, 0.9e0, 0.95e0]) AS threshold),
    e AS (SELECT threshold, query_id, min(CASE WHEN brand = true_brand THEN rank END) AS first_hit FROM h JOIN t ON similarity >= threshold GROUP BY ALL),
    q AS (SELECT count(DISTINCT query_id) AS total FROM h)
    SELECT t.threshold AS threshold, round(coalesce(sum(CASE WHEN first_hit = 1 THEN 1e0 ELSE 0 END) / any_value(total), 0), 6) AS recall_at_1,
        round(coalesce(sum(coalesce(1e0 / first_hit, 0)) / any_value(total), 0), 6) AS mrr, round(count(query_id) / any_value(CAST(total AS DOUBLE)), 6) AS coverage
    FROM t CROSS JOIN q LEFT JOIN e ON e.threshold = t.threshold GROUP BY t.threshold""".replace("e.threshold = t.threshold GROUP", "e.threshold = t.threshold AND e.query_id IS NOT NULL GROUP").replace("mrr, round(count(query_id)", "mrr, round(count(e.query_id)").replace("WHEN first_hit = 1 THEN 1e0 ELSE 0", "WHEN e.query_id IS NULL THEN NULL WHEN first_hit = 1 THEN 1e0 ELSE 0").replace("sum(coalesce(1e0 / first_hit, 0))", "sum(CASE WHEN e.query_id IS NOT NULL THEN coalesce(1e0 / first_hit, 0) END)"))
def threshold_sweep(spark, sf):
    return _rounded(R.sweep(_loo(spark, sf)), "recall_at_1", "mrr", "coverage")


@query(f"WITH {LOO} SELECT true_brand AS brand, round(avg(CASE WHEN first_hit <= 1 THEN 1e0 ELSE 0 END), 6) AS recall_at_1, count(*) AS n FROM f GROUP BY true_brand")
def per_brand_recall(spark, sf):
    return _rounded(R.by_brand(_loo(spark, sf)), "recall_at_1")


@query(f"""WITH {LOO}, r AS (SELECT CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model, true_brand AS brand, round(avg(CASE WHEN first_hit <= 1 THEN 1e0 ELSE 0 END), 6) AS r FROM f GROUP BY ALL)
    SELECT brand, coalesce(max(CASE WHEN model = 'even' THEN r END), 0) AS even, coalesce(max(CASE WHEN model = 'odd' THEN r END), 0) AS odd FROM r GROUP BY brand""")
def per_brand_pivot(spark, sf):
    hits = _loo(spark, sf).withColumn("model", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd"))
    first = hits.groupBy("model", "query_id", F.col("true_brand").alias("brand")).agg(F.min(F.when(F.col("brand") == F.col("true_brand"), F.col("rank"))).alias("first_hit"))
    return R.brand_by_model(_rounded(first.groupBy("model", "brand").agg(R.recall(1).alias("recall_at_1")), "recall_at_1"), ["even", "odd"])


@query(f"WITH {OTHERS.replace('{K}', '5').replace('q.vec_id <> g.vec_id', 'q.vec_id % 2 = 1 AND g.vec_id % 2 = 0')}, f AS (SELECT query_id, true_brand, min(CASE WHEN brand = true_brand THEN rank END) AS first_hit FROM h GROUP BY ALL) SELECT {SUMS} FROM f")
def crop_evaluation(spark, sf):
    """Odd ids are the crops, even ones the gallery: two tables, nothing held out."""
    v = table(spark, sf, "vectors")
    asked = v.where("vec_id % 2 = 1").select(F.col("vec_id").alias("query_id"), "embedding", F.col("brand").alias("true_brand"))
    return _rounded(R.summary(R.against(asked, v.where("vec_id % 2 = 0"))), "recall_at_1", "recall_at_3", "recall_at_5", "mrr")


@query(f"""WITH {LOO}, p AS (SELECT query_id, true_brand, min(CASE WHEN brand = true_brand THEN rank END) AS f, array_agg(brand ORDER BY rank) AS b, min(CASE WHEN rank = 1 THEN similarity END) AS s FROM h GROUP BY ALL)
    SELECT query_id, true_brand, b[1] AS rank1_brand, round(s, 4) AS rank1_score, round(2 * s - 1, 4) AS rank1_cosine, array_to_string(b[1:3], ';') AS rank3_brands, array_to_string(b[1:5], ';') AS rank5_brands,
        CASE WHEN f <= 1 THEN 1 ELSE 0 END AS recall_at_1, CASE WHEN f <= 3 THEN 1 ELSE 0 END AS recall_at_3, CASE WHEN f <= 5 THEN 1 ELSE 0 END AS recall_at_5, coalesce(1e0 / f, 0) AS reciprocal_rank FROM p""")
def loo_query_report(spark, sf):
    return R.query_report(_loo(spark, sf))


@query(f"""WITH {LOO}, s AS (SELECT {SUMS} FROM f)
    SELECT 'loo' AS model, 64 AS dim, format('{{{{:.4f}}}}', recall_at_1) AS recall_at_1, format('{{{{:.4f}}}}', recall_at_3) AS recall_at_3, format('{{{{:.4f}}}}', recall_at_5) AS recall_at_5, format('{{{{:.4f}}}}', mrr) AS mrr, n_queries FROM s""")
def summary_table(spark, sf):
    s = _rounded(R.summary(_loo(spark, sf)), "recall_at_1", "recall_at_3", "recall_at_5", "mrr")
    four = lambda c: F.format_string("%.4f", F.col(c)).alias(c)
    return s.orderBy(F.desc("recall_at_1")).select(F.lit("loo").alias("model"), F.lit(64).alias("dim"), four("recall_at_1"), four("recall_at_3"), four("recall_at_5"), four("mrr"), "n_queries")


@query("""SELECT vec_id, 128 AS dim, round(CAST(embedding[1] AS DOUBLE) / sqrt(2 * list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS first,
    round(CAST(embedding[64] AS DOUBLE) / sqrt(2 * list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS last FROM {embeddings}""")
def hybrid_embedding(spark, sf):
    h = table(spark, sf, "embeddings").select("vec_id", V.hybrid(F.col("embedding"), F.col("embedding")).alias("h"))
    return h.select("vec_id", F.size("h").alias("dim"), F.round(F.col("h")[0], 6).alias("first"), F.round(F.col("h")[127], 6).alias("last"))


@query("""WITH u AS (SELECT vec_id // 4 AS g, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS e FROM {embeddings}),
    x AS (SELECT g, unnest(generate_series(1, 64)) AS pos, unnest(e) AS v FROM u), m AS (SELECT g, pos, avg(v) AS v FROM x GROUP BY ALL),
    q AS (SELECT g AS query_id, array_agg(v ORDER BY pos) AS e FROM m GROUP BY g), n AS (SELECT query_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM q),
    d AS (SELECT query_id, vec_id, pow(list_distance(e, CAST(embedding AS DOUBLE[])), 2) AS d2 FROM n, {embeddings})
    SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) AS INT) AS rank, round(1 - d2 / 4, 6) AS similarity FROM d QUALIFY rank <= 3""")
def tta_mean_search(spark, sf):
    e = table(spark, sf, "embeddings")
    variants = e.select(F.floor(F.col("vec_id") / 4).alias("query_id"), "embedding")
    h = V.knn(V.mean_vectors(variants, "query_id"), e, 3)
    return h.select("query_id", "vec_id", "rank", F.round(V.similarity(F.col("d2")), 6).alias("similarity"))


@query("""SELECT a.vec_id AS vec_id, a.brand AS brand FROM [vectors] a WHERE a.brand = 'b0' AND NOT EXISTS
    (SELECT 1 FROM [vectors] b WHERE b.brand <> 'b0' AND 1 - pow(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 2) / 4 >= 0.7)""")
def skip_near_duplicates(spark, sf):
    v = table(spark, sf, "vectors")
    return V.skip_near(v.where("brand = 'b0'"), v.where("brand <> 'b0'"), 0.7).select("vec_id", "brand")


@query("""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (ORDER BY vec_id) AS i FROM {embeddings}),
    n AS (SELECT a.i AS i, any_value(a.vec_id) AS vec_id, list(b.i) FILTER (WHERE b.i IS NOT NULL) AS near FROM v a LEFT JOIN v b ON b.i < a.i AND 1 - pow(list_distance(a.e, b.e), 2) / 4 >= 0.7 GROUP BY a.i),
    r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT n.i, CASE WHEN list_has_any(r.kept, coalesce(n.near, []::BIGINT[])) THEN r.kept ELSE list_append(r.kept, n.i) END FROM r JOIN n ON n.i = r.i + 1)
    SELECT vec_id FROM n JOIN (SELECT unnest(kept) AS i FROM (SELECT kept FROM r ORDER BY i DESC LIMIT 1)) USING (i)""")
def insert_in_order(spark, sf):
    """The gallery built up row by row, each left out if one that is in it is near."""
    return V.insert_in_order(table(spark, sf, "embeddings"), 0.7).select("vec_id")


@query("""WITH g AS (SELECT max(vec_id) AS m FROM {embeddings}), n AS (SELECT vec_id AS source_id, brand, c.i AS copy FROM [vectors], (SELECT unnest([0, 1, 2]) AS i) c WHERE brand = 'b3')
    SELECT source_id, brand, copy, m + row_number() OVER (ORDER BY source_id, copy) AS vec_id FROM n, g""")
def gallery_append(spark, sf):
    v = table(spark, sf, "vectors")
    new = v.where("brand = 'b3'").select(F.col("vec_id").alias("source_id"), "brand")
    return V.number_from(v, new, ["source_id"], 3).select("source_id", "brand", "copy", "vec_id")


@query("""WITH t AS (SELECT image, max(logit) AS top FROM [logits] GROUP BY image), b AS (SELECT image, prompt AS best FROM [logits] QUALIFY row_number() OVER (PARTITION BY image ORDER BY logit DESC, prompt DESC) = 1),
    p AS (SELECT l.image AS image, 1e0 / sum(exp(logit - top)) AS p FROM [logits] l JOIN t USING (image) GROUP BY l.image)
    SELECT image, CASE WHEN p >= 0.8 THEN best END AS prompt, round(p, 6) AS probability FROM p JOIN b USING (image)""")
def zero_shot_argmax(spark, sf):
    return _rounded(V.zero_shot(table(spark, sf, "logits")), "probability")


@query("""WITH d AS (SELECT q.vec_id AS query_id, g.vec_id AS vec_id, CASE WHEN q.vec_id % 2 = 0 THEN 'clip' ELSE 'siglip' END AS space, pow(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(g.embedding AS DOUBLE[])), 2) AS d2
    FROM {embeddings} q JOIN {embeddings} g ON q.vec_id % 2 = g.vec_id % 2 AND q.vec_id <> g.vec_id)
    SELECT space, query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) AS INT) AS rank FROM d QUALIFY rank <= 3""")
def knn_by_space(spark, sf):
    e = table(spark, sf, "embeddings")
    have = {s: e.where(f"vec_id % 2 = {r}") for s, r in (("clip", 0), ("siglip", 1))}
    ask = {s: g.select(F.col("vec_id").alias("query_id"), "embedding") for s, g in have.items()}
    return V.by_space(ask, have, 3, leave_out_self=True).select("space", "query_id", "vec_id", "rank")
