"""Review labels, corrections and the metrics made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The spellings of corrections and of sources.
CORRECTIONS = {
    "typo": ["typo", "typo_correction", "typo_corrections"],
    "wrong": ["wrong", "wrong_attribution", "wrong_logo", "wrong_logo_attribution", "wrong_attributions"],
    "false_positive": ["false_positive", "fp", "false positive", "falsepositives", "false_positives"],
    "confirm": ["confirm", "confirmed", "confirmations", "confirmed_attribution"],
}
SOURCES = {"top2k_brands": ["top_2k_brands", "top2k", "top2k_brands"], "internal_db": ["database", "internal_db"], "audio": ["audio"]}


def _named(c: Column, table: dict[str, list[str]], other: Column) -> Column:
    key, out = F.lower(F.trim(F.coalesce(c, F.lit("")))), other
    for name, words in table.items():
        out = F.when(key.isin(*words), name).otherwise(out)
    return out


def correction(c: Column) -> Column:
    """A correction by its one name, '' if it is none."""
    return _named(c, CORRECTIONS, F.lit(""))


def source_key(c: Column) -> Column:
    """A source by its one name, null if it is none."""
    return _named(c, SOURCES, F.lit(None).cast("string"))


def _n(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def _rates(rows: DataFrame) -> DataFrame:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), F.lit(0.0))
    r = rows.withColumn("precision", share("tp", "fp")).withColumn("recall", share("tp", "fn"))
    return r.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def review_metrics(rows: DataFrame, wrong_brand_is_fp: bool = False) -> DataFrame:
    """Counts of labels and precision, recall and F1; a wrong brand counts as none of them, or as a false positive."""
    label = effective_label(F.col("label"), wrong_brand_is_fp)
    n = rows.select(label.alias("label")).agg(_n((F.col("label") != "") & F.col("label").isNotNull()).alias("labelled"), F.count("*").alias("total"), *(_n(F.col("label") == x).alias(a) for x, a in (("TP", "tp"), ("FP", "fp"), ("FN", "fn"), ("wrong_brand", "wrong_brand"))))
    return _rates(n)


def effective_label(label: Column, wrong_brand_is_fp: bool) -> Column:
    return F.when(F.lit(wrong_brand_is_fp) & (label == "wrong_brand"), "FP").otherwise(label)


def export(rows: DataFrame, labelled_only: bool, wrong_brand_is_fp: bool) -> DataFrame:
    """Rows with effective_label and is_correct, and summary rows (kind 'summary') under the same columns."""
    if labelled_only:
        rows = rows.where("label is not null and label <> ''")
    detail = rows.withColumn("effective_label", effective_label(F.col("label"), wrong_brand_is_fp)).withColumn("is_correct", F.when(F.col("label") == "TP", True).when(F.col("label").isin("FP", "FN", "wrong_brand"), False))
    m = review_metrics(rows, wrong_brand_is_fp)
    number = lambda c: F.format_string("%.4f", F.col(c))
    named = [("TP", F.col("tp").cast("string")), ("FP", F.col("fp").cast("string")), ("FN", F.col("fn").cast("string")), ("wrong_brand", F.col("wrong_brand").cast("string")), ("Precision", number("precision")), ("Recall", number("recall")), ("F1", number("f1")), ("wb_counted_as_FP", F.lit(str(wrong_brand_is_fp)))]
    lines = m.select(F.explode(F.array(*(F.struct(F.lit(k).alias("det_id"), v.alias("label")) for k, v in named))).alias("s")).select("s.det_id", "s.label")
    return detail.withColumn("det_id", F.col("det_id").cast("string")).withColumn("kind", F.lit("detail")).unionByName(lines.withColumn("kind", F.lit("summary")), allowMissingColumns=True)


def review_filter(rows: DataFrame, is_logo: list[str], labels: list[str], unlabelled: bool, low: float, high: float) -> DataFrame:
    """Rows of the chosen kinds, labels and confidence (null counts as 50); an empty choice filters nothing."""
    out = rows.where(F.coalesce("confidence", F.lit(50)).between(low, high))
    if is_logo:
        out = out.where(F.col("is_logo").isin(*is_logo))
    if labels or unlabelled:
        none = F.col("label").isNull() | (F.col("label") == "")
        out = out.where((F.col("label").isin(*labels) if labels else F.lit(False)) | (none if unlabelled else F.lit(False)))
    return out


def verdict_counts(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows per verdict, null as a dash, in display order; others come last."""
    v = F.coalesce("verdict", F.lit("—"))
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("verdict")), F.lit(0))
    return rows.groupBy(v.alias("verdict")).agg(F.count("*").alias("n")).withColumn("place", F.when(place == 0, len(order) + 1).otherwise(place).cast("int"))


def prediction_counts(rows: DataFrame) -> DataFrame:
    """Detections by kind, unparsed ones, unknown brands and truncated ones."""
    return rows.agg(F.count("*").alias("total"), *(_n(F.col("is_logo") == k).alias(k) for k in ("logo", "partial_logo", "not_logo")), _n(F.col("is_logo").isNull()).alias("unparsed"), _n(F.col("brand") == "UNKNOWN").alias("unknown_brand"), _n(F.col("is_truncated")).alias("truncated"))


def source_metrics(rows: DataFrame) -> DataFrame:
    """Counts by source over rows (source, correction); source 'all' counts every corrected row."""
    c = rows.select(source_key(F.col("source")).alias("source"), correction(F.col("correction")).alias("c")).where("c <> ''")
    both = c.withColumn("source", F.explode(F.array_compact(F.array(F.lit("all"), "source"))))
    return both.groupBy("source").agg(F.count("*").alias("processed"), _n(F.col("c") != "confirm").alias("errors"), _n(F.col("c") == "false_positive").alias("false_positives"), _n(F.col("c") == "typo").alias("typo_corrections"), _n(F.col("c") == "wrong").alias("wrong_attributions"), _n(F.col("c") == "confirm").alias("confirmed_attributions"))


def misses(confirmations: DataFrame) -> DataFrame:
    """False negatives by brand from confirmed unknowns."""
    b = F.trim(F.coalesce("brand", F.lit("")))
    return confirmations.select(b.alias("brand")).where("brand <> ''").groupBy("brand").agg(F.count("*").alias("false_negatives"))


def brand_breakdown(known: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Six counts of each brand among known(brand, filepath, correction) or confirmed unknowns; a path counts once."""
    c = known.select("brand", "filepath", correction(F.col("correction")).alias("c")).where("brand is not null and brand <> ''")
    c = c.groupBy("brand", "filepath").agg(F.max("c").alias("c"))
    counts = c.groupBy("brand").agg(F.count("*").alias("total_images"), _n(F.col("c") == "confirm").alias("confirmed"), _n(F.col("c") == "false_positive").alias("false_positives"), _n(F.col("c") == "typo").alias("typos"), _n(F.col("c") == "wrong").alias("wrong_attribution"), _n(F.col("c") == "").alias("not_reviewed"))
    return counts.join(misses(confirmations), "brand", "full_outer").fillna(0)


def brand_overview(known: DataFrame, confirmations: DataFrame) -> DataFrame:
    """How many brands have each kind of correction at least once; those without a reviewed image count as not reviewed."""
    b = brand_breakdown(known, confirmations)
    has = lambda c: _n(F.col(c) > 0)
    return b.agg(F.count("*").alias("brands"), _n(F.col("total_images") == F.col("not_reviewed")).alias("not_reviewed"), has("false_positives").alias("with_false_positive"), has("false_negatives").alias("with_false_negative"), has("typos").alias("with_typo"), has("wrong_attribution").alias("with_wrong_attribution"), has("confirmed").alias("with_confirmed"))


def count_share(n: Column, total: Column) -> Column:
    """'n (p%)'; 0% without a total."""
    share = F.coalesce(F.try_divide(n * 100.0, total), F.lit(0.0))
    return F.format_string("%d (%.1f%%)", n, share)


def overlay(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Base rows with the columns of `changes` where it has the key and a value."""
    c = changes.select(key, *(F.col(x).alias(f"_{x}") for x in columns))
    return base.join(c, key, "left").select(*(F.coalesce(f"_{x}", x).alias(x) if x in columns else F.col(x) for x in base.columns))


def assigned_brands(rows: DataFrame) -> DataFrame:
    """Distinct brands but UNKNOWN and blanks."""
    return rows.where("trim(coalesce(brand, '')) not in ('', 'UNKNOWN')").select("brand").distinct()


def known_tab(known: DataFrame, brand: str | None = None, verdict: str | None = None, status: str | None = None, reviews: DataFrame | None = None, key: str = "filepath") -> DataFrame:
    """Known rows by brand, verdict and review status; None asks for nothing.

    reviews(key, status): rows without a review have the status ''.
    """
    out = known
    if brand is not None:
        out = out.where(F.col("brand") == brand)
    if verdict is not None:
        out = out.where(F.col("verdict") == verdict)
    if status is not None:
        if reviews is None:
            raise ValueError("a status is asked for without reviews")
        last = reviews.groupBy(key).agg(F.max("status").alias("_status"))
        out = out.join(last, key, "left").where(F.coalesce("_status", F.lit("")) == status).drop("_status")
    return out


def without_false_positives(known: DataFrame, column: str = "correction") -> DataFrame:
    """Known rows whose correction does not say that they are no logo."""
    return known.where(correction(F.col(column)) != "false_positive")


def pair_by_stem(images: DataFrame, labels: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Images with the label file of the same stem (image, label, stem), and one row that counts images, pairs and missing labels.

    Stems are names without folder and last suffix; of several label files of a
    stem the first by path is taken.
    """
    stem = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")
    have = labels.select(stem(F.col(path)).alias("stem"), F.col(path).alias("label")).groupBy("stem").agg(F.min("label").alias("label"))
    rows = images.select(F.col(path).alias("image"), stem(F.col(path)).alias("stem")).join(have, "stem", "left")
    counts = rows.agg(F.count("*").alias("images"), F.count("label").alias("pairs"), F.count_if(F.col("label").isNull()).alias("missing"))
    return rows.where("label is not null").select("image", "label", "stem"), counts
