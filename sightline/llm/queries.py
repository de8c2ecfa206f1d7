"""The operators' queries over the standard tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, embedding_dedup, exact_dedup, language_id, minhash, packing, periods, quality, substring_dedup, token_counts, token_files, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_groups(_table(spark, sf_dir, "embeddings"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out(5, 0))
    labels = _table(spark, sf_dir, "labels").where(~language_id.held_out(5, 0))
    model = quality.fit(docs.where(~F.col("held_out")), labels)
    return quality.score(docs, model, "held_out").select("doc_id", "held_out", "score", "predicted")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out(3, 1))
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.predict(docs, model, "held_out").select("doc_id", "held_out", "lang_pred", "score")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out(5, 0))
    labels = _table(spark, sf_dir, "labels").where(~language_id.held_out(5, 0))
    model = toxicity.fit(docs.where(~F.col("held_out")), labels)
    return toxicity.score(docs, model, "held_out").select("doc_id", "held_out", "score", "predicted")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.summarise(periods.find_runs(periods.with_planted(_table(spark, sf_dir, "documents"))))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_byte_bpe, op3_quality, op4_exact_dedup, op5_packing, op6_substring_dedup, op7_token_files, op8_language_id, op9_minhash, op10_token_counts, op11_toxicity, op12_periodic_runs, op13_source_divergence)}

#: Vectors that link, and all that can be reached by links; documents likewise.  Both compare all pairs, which DuckDB does
#: within seconds on the small tables.
REACH = "reach AS (SELECT id AS a, id AS b FROM ids UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)"

SQL = {
    "op1_embedding_dedup": f"""
        WITH RECURSIVE ids AS (SELECT DISTINCT vec_id AS id FROM embeddings),
        v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v WHERE list_inner_product(e, e) > 0),
        links AS (SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.id <> y.id AND len(x.e) = len(y.e) AND list_inner_product(x.e, y.e) >= 0.95),
        {REACH}
        SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, (SELECT min(b) FROM reach WHERE a = id) AS component_id,
               id = (SELECT min(b) FROM reach WHERE a = id) AS kept FROM ids""",
    "op9_minhash": f"""
        WITH RECURSIVE ids AS (SELECT DISTINCT doc_id AS id FROM documents),
        w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
        e AS (SELECT id, len(s) AS n, unnest(s) AS shingle FROM s),
        links AS (SELECT x.id AS a, y.id AS b FROM e x JOIN e y ON x.shingle = y.shingle AND x.id <> y.id GROUP BY x.id, y.id HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
        {REACH}, least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT s.id AS doc_id, len(s.s) AS n_shingles, least.b AS component_id, s.id = least.b AS kept FROM s JOIN least ON s.id = least.a""",
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op13_source_divergence": """
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
        c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
        s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                     1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.n, 0)::HUGEINT + 5 * v.v) AS p,
                     1 + (1000000000::HUGEINT * (k.n + 5)) // (v.n::HUGEINT + 5 * v.v) AS q
              FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
              LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
        a AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
              LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
              UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM a)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 50""",
}
