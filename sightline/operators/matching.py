"""Fuzzy joins, prompts, and boxes in answers.

Names are scored once for each distinct text, and only those names that an
inverted index does not rule out (name_index).  The list of brands is a
dictionary: its size is checked, and a longer list is dealt by blocks, each with
an index of its own, instead of being sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from .name_index import NameIndex

#: Longest list of brands that goes to every task, in bytes of text, and names of a block otherwise.
MOST_BYTES, BLOCK = 16 << 20, 20_000


def best_match(queries: DataFrame, query: str, brands: DataFrame, brand: str, scorer: str, least: float, short_extra: float = 15.0, strict: bool = False, place: str | None = None) -> DataFrame:
    """query, brand and score of the best brand for each distinct query; brand is null where the score stays below.

    Texts of fewer than four characters need `short_extra` more.  Ties go to
    the brand that comes first by name, or by the column `place` of the list.
    strict: the limit itself is not enough.
    """
    order = F.col(place).cast("double") if place else F.lit(0.0)
    names = brands.select(F.col(brand).cast("string").alias(brand), order.alias("_p")).where(F.col(brand).isNotNull()).groupBy(brand).agg(F.min("_p").alias("_p"))
    asked = queries.select(F.col(query).cast("string").alias(query)).where(F.col(query).isNotNull()).distinct()
    schema = f"`{query}` string, `{brand}` string, score double, _p double"

    def best(q: list[str], b: list[tuple[float, str]], index: NameIndex) -> pd.DataFrame:
        found = zip(q, index.best_of_each(q), strict=True)
        rows = [(x, b[top[1]][1], float(top[0]), b[top[1]][0]) for x, top in found if top]
        return pd.DataFrame(rows, columns=[query, brand, "score", "_p"])

    n, bytes_ = names.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(brand)), F.lit(0))).first()
    if bytes_ <= MOST_BYTES:
        shared = queries.sparkSession.sparkContext.broadcast(sorted((r["_p"], r[brand]) for r in names.collect()))  # checked above

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = NameIndex([y for _, y in shared.value], scorer)
            for part in batches:
                yield best(part[query].tolist(), shared.value, index)

        # A few small rows make much work, so they are dealt to all tasks instead of being put together by size.
        tasks = max(queries.sparkSession.sparkContext.defaultParallelism, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        found = asked.repartition(tasks, query).mapInPandas(run, schema)
    else:
        # Blocks of texts meet blocks of names; both are of bounded size, whichever side is the larger.
        across, down = -(-n // BLOCK), max(1, -(-asked.count() // BLOCK))
        texts = asked.withColumn("_t", F.pmod(F.xxhash64(query), F.lit(down))).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
        blocks = names.withColumn("_b", F.pmod(F.xxhash64(brand), F.lit(across))).withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))

        def meet(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            listed = sorted(zip(b["_p"], b[brand], strict=True))
            return best(q[query].tolist(), listed, NameIndex([y for _, y in listed], scorer))

        each = texts.groupBy("_t", "_b").cogroup(blocks.groupBy("_t", "_b")).applyInPandas(meet, schema)
        # Less than the best score by more, then the place, then the name; merged before the shuffle.
        top = F.min_by(F.struct(brand, "score", "_p"), F.struct(-F.col("score"), "_p", brand))
        found = each.groupBy(query).agg(top.alias("_s")).select(query, f"_s.`{brand}`", "_s.score", "_s._p")
    need = F.lit(least) + F.when(F.length(F.trim(query)) < 4, short_extra if least else 0.0).otherwise(0.0)
    taken = F.col("score") > need if strict else F.col("score") >= need
    return found.select(query, F.when(taken, F.col(brand)).alias(brand), "score")


def best_match_batch(queries: DataFrame, query: str, brands: DataFrame, brand: str, place: str, least: float = 70.0) -> DataFrame:
    """best_match by wratio as the batch form has it, for each distinct query.

    Queries are taken trimmed and in lower case; a score below `least` is 0;
    the limit has to be passed; ties go to the first of the list; no match is
    UNKNOWN.  An empty list is an error.
    """
    if brands.where(F.col(brand).isNotNull()).isEmpty():
        raise ValueError("no brands to match with")
    asked = queries.select(query).where(F.col(query).isNotNull()).distinct().withColumn("_q", F.regexp_replace(F.lower(query), r"^\s+|\s+$", ""))
    m = best_match(asked, "_q", brands, brand, "wratio", least, strict=True, place=place)
    score = F.when(F.col("score") >= least, F.col("score")).otherwise(0.0)
    return asked.join(m, "_q").select(query, F.coalesce(brand, F.lit("UNKNOWN")).alias(brand), score.alias("score"))


def audio_technique(items: DataFrame, key: str, ocr: str, brands: DataFrame, brand: str, place: str, batch: bool = False, least: float = 80.0) -> DataFrame:
    """OCR texts matched with the brands that were heard: key, brand, score, ocr_text, source.

    One by one a text needs three characters and 70 points; in batch form it
    needs no length, and more than `least` points.  Brands are taken trimmed
    and in lower case.
    """
    heard = brands.select(F.lower(F.trim(brand)).alias(brand), place)
    text = F.coalesce(F.col(ocr), F.lit(""))
    rows = items.select(key, (F.trim(text) if batch else text).alias("ocr_text"))
    if batch:
        m = best_match_batch(rows, "ocr_text", heard, brand, place, least)
    else:
        m = best_match(rows.where(F.length("ocr_text") >= 3), "ocr_text", heard, brand, "wratio", 70.0, place=place)
    out = rows.join(m, "ocr_text", "left")
    return out.select(key, F.coalesce(brand, F.lit("UNKNOWN")).alias("brand"), "score", "ocr_text", F.lit("audio").alias("source"))


def robust_match(queries: DataFrame, query: str, brands: DataFrame, brand: str, compat: bool = False) -> DataFrame:
    """The best brand by the whole score, accepted if the partial score agrees (cascade.robust)."""
    from .cascade import robust

    m = best_match(queries, query, brands, brand, "wratio", 0.0)
    m = m.withColumn("partial", S.score("partial_ratio", F.col(query), F.col(brand)))
    return m.select(query, F.when(robust(F.col(query), F.col("score"), F.col("partial"), compat), F.col(brand)).alias(brand), "score", "partial")


def mean_pairwise(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Mean ratio (0 to 1) of the pairs of distinct names of each key; keys with one name are left out.

    Groups are the few answers given for one crop.
    """
    a = rows.select(key, F.col(name).alias("_a"))
    pairs = a.join(rows.select(key, F.col(name).alias("_b")), key).where("_a < _b")
    return pairs.groupBy(key).agg(F.round(F.avg(S.score("ratio", F.col("_a"), F.col("_b")) / 100.0), 6).alias("similarity"), F.count("*").alias("pairs"))


def boosted(score: Column, text: Column, names: Column, limit: float = 70.0, extra: float = 5.0) -> Column:
    """The score, raised where the text has most of its words in common with one of the names."""

    @F.pandas_udf("boolean")
    def close(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([any(S.token_set_ratio(x or "", y) >= limit for y in ys) for x, ys in zip(t, n, strict=True)], dtype=bool)

    return F.when(close(text, names), F.least(F.lit(100.0), score + extra)).otherwise(score)


def prompt(sections: list[tuple[str, Column]]) -> Column:
    """A prompt of sections in order, each a heading and its items joined by commas."""
    parts = []
    for name, items in sections:
        parts.append(F.concat(F.lit(f"## {name}\n"), F.when(F.size(items) > 0, F.array_join(items, ", ")).otherwise("(none detected)")))
    return F.concat_ws("\n", *parts)


def box_1000(answer: Column, width: Column, height: Column) -> Column:
    """A box in thousandths as pixels.

    JSON (bbox_2d) gives x1, y1, x2, y2; four numbers in brackets in plain text
    give y1, x1, y2, x2.  Null without either.
    """
    j = F.from_json(answer, "bbox_2d array<double>")["bbox_2d"]
    pattern = r"\[\s*([\d.]+)\s*,\s*([\d.]+)\s*,\s*([\d.]+)\s*,\s*([\d.]+)\s*\]"
    t = [F.regexp_extract(answer, pattern, k).try_cast("double") for k in (1, 2, 3, 4)]
    px = lambda a, b, size: (F.coalesce(F.get(j, F.lit(a)), t[b]) / 1000.0 * size).cast("int")
    return F.struct(px(0, 1, width).alias("x1"), px(1, 0, height).alias("y1"), px(2, 3, width).alias("x2"), px(3, 2, height).alias("y2"))
