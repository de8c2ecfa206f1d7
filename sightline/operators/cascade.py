"""First-match-wins chains and gated decisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .seams import BrokenSeam

UNKNOWN = "UNKNOWN"
#: Gates of the gallery technique.
FALSE_LOGO, STRICT, CONSENSUS, VOTES, SHARE, TEXT_SCORE, LEAST_TEXT = 0.93, 0.97, 0.90, 4, 0.4, 80.0, 3

#: A technique takes unknown items and returns (key, brand, score); a post-filter takes rows and returns (logo_id, raw) for
#: those it looked at.  seams has the contracts of these and of embedders and detectors, and checks them.
Technique = Callable[[DataFrame], DataFrame]
PostFilter = Callable[[DataFrame], DataFrame]


def first_match(items: DataFrame, techniques: list[tuple[str, Technique]], key: str = "id") -> DataFrame:
    """Run techniques in order, each on what is still unknown; a technique returns (key, brand, score).

    Explicit anti-joins keep a costly technique from running on settled rows.
    """
    left, done = items, None
    for name, run in techniques:
        got = run(left)
        if missing := [c for c in (key, "brand", "score") if c not in got.columns]:
            raise BrokenSeam(f"technique {name} gives no {', '.join(missing)}")
        got = got.where(F.coalesce("brand", F.lit(UNKNOWN)) != UNKNOWN).select(key, "brand", F.col("score").cast("double").alias("score"), F.lit(name).alias("technique"))
        done = got if done is None else done.unionByName(got)
        left = left.join(got.select(key), key, "left_anti")
    rest = left.select(key, F.lit(UNKNOWN).alias("brand"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("technique"))
    return rest if done is None else done.unionByName(rest)


def first_known(options: list[tuple[str, Column, Column]]) -> dict[str, Column]:
    """The same over precomputed columns (name, brand, score): brand, technique and score of the first that is known."""
    brand, technique, score = F.lit(UNKNOWN), F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, b, s in reversed(options):
        known = F.coalesce(b, F.lit(UNKNOWN)) != UNKNOWN
        brand, technique, score = F.when(known, b).otherwise(brand), F.when(known, F.lit(name)).otherwise(technique), F.when(known, s.cast("double")).otherwise(score)
    return {"brand": brand, "technique": technique, "score": score}


def gallery_gates(top_brand: Column, top: Column, winner: Column, votes: Column, share: Column, ocr: Column, fuzzy_brand: Column, fuzzy: Column, strict: float = STRICT, consensus: float = CONSENSUS, false_logo: float = FALSE_LOGO) -> dict[str, Column]:
    """Brand, score and gate of the gallery technique from the best hit, the vote and the best text match.

    In order: a false logo that is near is unknown; no hit is unknown; a very
    near hit is taken; a near hit that wins the vote is taken by its lower-case
    name; a text that is too short is unknown; a good text match is taken.
    """
    ocr_ = F.lower(F.trim(F.coalesce(ocr, F.lit(""))))
    gate = (
        F.when((F.lower(F.trim(top_brand)) == "false_logo") & (top >= false_logo), "false_logo")
        .when(top.isNull(), "no_hit")
        .when(top >= strict, "strict")
        .when((top >= consensus) & (votes >= VOTES) & (share >= SHARE) & (F.lower(F.trim(winner)) == F.lower(F.trim(top_brand))), "consensus")
        .when(F.length(ocr_) < LEAST_TEXT, "short_text")
        .when(fuzzy >= TEXT_SCORE, "text")
        .otherwise("none")
    )
    brand = F.when(gate == "strict", top_brand).when(gate == "consensus", F.lower(winner)).when(gate == "text", fuzzy_brand).otherwise(UNKNOWN)
    score = F.when(gate.isin("strict", "consensus"), top).when(gate == "text", fuzzy / 100.0).otherwise(0.0)
    return {"brand": brand, "score": score, "gate": gate}


def text_or_visual(ocr: Column, brand: Column, top: Column, full: Column, partial: Column, strict: float = FALSE_LOGO) -> Column:
    """The older gallery technique: without texts a very near hit, else a robust match of the OCR text with the brand."""
    none = (F.length(F.trim(F.coalesce(ocr, F.lit("")))) == 0) | (F.length(F.trim(F.coalesce(brand, F.lit("")))) == 0)
    return F.when(none & (top >= strict), brand).when(~none & robust(ocr, full, partial), brand).otherwise(UNKNOWN)


def robust(text: Column, full: Column, partial: Column, compat: bool = False) -> Column:
    """A match by two scores: 75 and 80, or 85 for texts of three characters. In `compat` form 85 alone suffices for those."""
    n = F.length(F.trim(text))
    if compat:
        return F.coalesce((n >= 3) & (((full >= 75) & (partial >= 80)) | ((n <= 3) & (full >= 85))), F.lit(False))
    return F.coalesce((n >= 3) & ~((n <= 3) & (full < 85)) & (full >= 75) & (partial >= 80), F.lit(False))


def postfilter(rows: DataFrame, verdicts: DataFrame, sources: list[str], method: str) -> DataFrame:
    """Verdicts (logo_id, raw) applied to rows of the given sources; others are Skipped.

    Adds postfilter_method, postfilter_applied, postfilter_verdict and kept,
    and sets the brand of rows that are not kept to UNKNOWN.
    """
    return postfilters(rows, [(method, sources, lambda _: verdicts)])


def postfilters(rows: DataFrame, strategies: list[tuple[str, list[str], PostFilter]]) -> DataFrame:
    """Strategies (name, sources, post-filter) in order.

    A strategy is asked about the rows of its sources, without those whose
    image can't be read if there is a column `readable`; the name of the first
    strategy stays and the last verdict counts.  Of several answers for a logo
    the least text counts.
    """
    out = rows.withColumn("_v", F.lit(None).cast("string"))
    for _, sources, ask in strategies:
        asked = F.lower(F.trim("source")).isin(*sources)
        if "readable" in rows.columns:
            asked = asked & F.col("readable")
        asked = F.coalesce(asked, F.lit(False))
        answers = ask(out.where(asked).drop("_v")).where("raw is not null").groupBy("logo_id").agg(F.min("raw").alias("_raw"))
        out = out.join(answers, "logo_id", "left").withColumn("_v", F.when(asked & F.col("_raw").isNotNull(), T.verdict(F.col("_raw"))).otherwise(F.col("_v"))).drop("_raw")
    out = out.withColumn("postfilter_method", F.lit(strategies[0][0] if strategies else None).cast("string"))
    out = out.withColumn("postfilter_applied", F.col("_v").isNotNull()).withColumn("postfilter_verdict", F.coalesce("_v", F.lit("Skipped"))).drop("_v")
    kept = ~F.col("postfilter_applied") | (F.col("postfilter_verdict") == "Correct")
    return out.withColumn("kept", kept).withColumn("brand", F.when(F.col("kept"), F.col("brand")).otherwise(UNKNOWN))


def postfilter_outputs(rows: DataFrame, frames: DataFrame, strategies: list[tuple[str, list[str], PostFilter]]) -> dict[str, DataFrame]:
    """The four outputs of post-filtering: rows (logo_id, frame, source, brand, ...), frames (frame, timestamp).

    annotated: all rows; filtered: those that are kept; frames and
    filtered_frames: a row per frame, with its results in order (all of them, or
    the kept ones).  Frames without results stay, with an empty list.
    """
    annotated = postfilters(rows, strategies)
    methods = " | ".join(name for name, _, _ in strategies)
    result = F.struct("logo_id", "brand", F.struct(F.lit(methods).alias("method"), F.col("postfilter_verdict").alias("verdict"), F.col("postfilter_applied").alias("applied")).alias("postfilter"), "kept")
    each = frames.join(annotated.groupBy("frame").agg(F.sort_array(F.collect_list(result)).alias("results")), "frame", "left")
    each = each.withColumn("results", F.coalesce("results", F.array()))
    kept = F.filter("results", lambda r: r["kept"])
    return {"filtered": annotated.where("kept"), "annotated": annotated, "frames": each, "filtered_frames": each.withColumn("results", kept)}


def text_then_prompt(items: DataFrame, key: str, text: str, brands: DataFrame, brand: str, zero_shot: DataFrame, least: float = 90.0) -> DataFrame:
    """The brand that a text matches well, else the zero-shot prompt (key, prompt, probability): key, brand, technique, score.

    Texts count from four characters on, in normal form.  A prompt is taken as
    it stands.
    """
    from .matching import best_match

    rows = items.select(key, T.normalize(F.col(text)).alias("_q"))
    m = best_match(rows.where(F.length("_q") >= 4), "_q", brands, brand, "wratio", least)
    j = rows.join(m.select("_q", F.col(brand).alias("_m"), F.col("score").alias("_s")), "_q", "left").join(zero_shot.select(key, "prompt", "probability"), key, "left")
    pick = first_known([("text", F.col("_m"), F.col("_s")), ("zero_shot", F.col("prompt"), F.col("probability"))])
    return j.select(key, *(c.alias(n) for n, c in pick.items()))


def route(p_global: Column, name_similarity: Column, p_multiple: Column, p_logo: Column, poster: Column, stylized: Column, design: Column) -> Column:
    """Where a crop goes: LLM, API or EXCLUDE."""
    return (
        F.when((p_global >= 0.8) & (name_similarity >= 0.8), "LLM")
        .when(p_multiple >= 0.67, "EXCLUDE")
        .when((p_logo >= 0.5) & ~poster, "API")
        .when(poster, "EXCLUDE")
        .when(stylized | design, "API")
        .otherwise("EXCLUDE")
    )


def yes_no(answers: DataFrame, key: str, answer: str, whole_words: bool = False) -> DataFrame:
    """Share of yes among answers that say yes or no; null if none does.

    Words are found as substrings, so "know" says no; `whole_words` asks for words.
    """
    x = F.lower(answer)
    has = (lambda w: x.rlike(rf"\b{w}\b")) if whole_words else (lambda w: x.contains(w))
    yes, no = F.coalesce(has("yes"), F.lit(False)), F.coalesce(has("no"), F.lit(False))
    said = answers.select(key, yes.cast("int").alias("yes"), (yes | no).cast("int").alias("include"))
    s = said.groupBy(key).agg(F.sum("yes").alias("yes"), F.sum("include").alias("include"))
    return s.withColumn("probability", F.try_divide("yes", "include"))


def candidates(sources: DataFrame, enabled: list[str], key: str = "id") -> DataFrame:
    """Candidate names (key, signal, signal_order, pos, name) of enabled signals, each once whatever its case, in order: key, ord, name."""
    rows = sources.where(F.col("signal").isin(*enabled)).withColumn("_k", F.lower(F.trim("name"))).where("_k <> ''")
    first = rows.withColumn("_t", F.row_number().over(Window.partitionBy(key, "_k").orderBy("signal_order", "pos"))).where("_t = 1")
    return first.select(key, F.row_number().over(Window.partitionBy(key).orderBy("signal_order", "pos")).alias("ord"), "name")
