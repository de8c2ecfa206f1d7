"""Evidence of a detection: which signals are on, how they read in a prompt, and the flat table of predictions.

Model output comes as columns.  Hints have faiss_top_k (brand_name,
similarity) and ocr (lines, source); predictions have the fields of
`readers.PREDICTION`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T

NONE = "(none detected)"


def enabled_signals(names: list[str] | None = None) -> list[str]:
    """The signals that are on, in their canonical order; all without a list.  A name that is no signal is an error."""
    if names is None:
        return list(T.SIGNALS)
    if unknown := sorted(set(names) - set(T.SIGNALS)):
        raise ValueError(f"no such signal: {', '.join(unknown)}; there are {', '.join(T.SIGNALS)}")
    return [s for s in T.SIGNALS if s in names]


def signal_text(score: Column, timecode: Column, offsets: Column, audio: Column, matches: Column, lines: Column) -> dict[str, Column]:
    """What a prompt says of each signal: scores and similarities with three places, times with one, OCR confidence with two.

    Signals with nothing to show say so; image signals give the caption that
    goes before the image, and are null without their column.
    """
    numbered = F.transform(matches, lambda m, i: F.format_string("%d. %s (%.3f)", i + 1, m["brand_name"], m["similarity"]))
    read = F.transform(lines, lambda x: F.format_string('"%s" (%.2f)', x["text"], x["confidence"]))
    quoted = F.transform(audio, lambda b: F.concat(F.lit('"'), b, F.lit('"')))
    listed = lambda items, sep: F.when(F.size(items) > 0, F.array_join(items, sep)).otherwise(NONE)
    return {
        "tight_crop": F.format_string("detector score %.3f", score),
        "enlarged_crop": F.lit("the surroundings"),
        "full_frame": F.format_string("at %.1f s", timecode),
        "temporal_context": F.array_join(F.transform(offsets, lambda o: F.concat(F.lit("T"), o)), ", "),
        "audio_brands": listed(quoted, ", "),
        "faiss_matches": listed(numbered, "\n"),
        "ocr_text": listed(read, "\n"),
    }


def brand_rule(candidates: Column, closed: bool) -> Column:
    """What an answer may name: anything (open), one of the candidates, or only UNKNOWN where there is none."""
    if not closed:
        return F.lit("Name the brand, whether a hint has it or not; UNKNOWN if it can't be told.")
    names = F.array_join(F.transform(candidates, lambda c: F.concat(F.lit('"'), c, F.lit('"'))), ", ")
    return F.when(F.size(candidates) > 0, F.concat(F.lit("Name one of ["), names, F.lit("], or UNKNOWN."))).otherwise("There are no candidates: answer UNKNOWN.")


def prompt(sections: dict[str, Column], signals: list[str], rule: Column, watermark: str = "") -> Column:
    """The enabled signals in order, each under its name, then a known watermark and the rule for the brand."""
    parts = [F.concat(F.lit(f"## Signal: {s}\n"), sections[s]) for s in enabled_signals(signals)]
    if watermark:
        parts.append(F.lit(f'The channel\'s own mark is "{watermark}".'))
    return F.concat_ws("\n", *parts, rule)


def canonical_map(raw: Column) -> Column:
    """Names by their canonical spelling from a model's JSON object; blank values count for nothing, null if it is no JSON."""
    m = F.from_json(T.outer_json(raw), "map<string,string>")
    return F.map_filter(F.transform_values(m, lambda _, v: F.trim(v)), lambda _, v: F.coalesce(v, F.lit("")) != "")


def canonical_brand(brand: Column, mapping: Column) -> Column:
    """The canonical spelling; a name that the mapping lacks stays, UNKNOWN and null stay in any case."""
    return F.when(brand == "UNKNOWN", brand).otherwise(F.coalesce(F.try_element_at(mapping, brand), brand))


def flat_predictions(detections: DataFrame, predictions: DataFrame, hints: DataFrame, audio: list[str], experiment: str = "", mode: str = "open", signals: list[str] | None = None, root: str = "") -> DataFrame:
    """One row per detection with 29 columns, lists as JSON; prediction and hints may be absent.

    Both have at most one row per det_id.  `label` is left empty for the review.
    """
    on = F.array(*map(F.lit, enabled_signals(signals)))
    suffix = f"__{experiment}" if experiment else ""
    p = predictions.select("det_id", F.struct(*(c for c in predictions.columns if c != "det_id")).alias("p"))
    h = hints.select("det_id", "faiss_top_k", "ocr")
    j = detections.join(p, "det_id", "left").join(h, "det_id", "left")
    hits = F.coalesce(F.col("faiss_top_k"), F.array().cast("array<struct<brand_name:string,similarity:double>>"))
    lines = F.coalesce(F.col("ocr.lines"), F.array().cast("array<struct<text:string,confidence:double>>"))
    used = F.coalesce(F.col("p.signals_used"), F.array().cast("array<string>"))
    frame = F.format_string("%06d", "frame_idx")
    at = lambda *parts: F.concat(F.lit(f"{root}/" if root else ""), *parts)
    return j.select(
        "det_id", "frame_idx", F.col("timecode_seconds").alias("timecode_s"), F.round("score", 4).alias("det_score"), F.to_json("box_xyxy").alias("box_xyxy"),
        at(F.col("crop_path")).alias("crop_path"), at(F.col("crop_enlarged_path")).alias("enlarged_crop_path"),
        at(F.lit("detections/frame_"), frame, F.lit("/frame.jpg")).alias("frame_path"), at(F.lit(f"annotated_frames{suffix}/frame_"), frame, F.lit(".jpg")).alias("annotated_frame_path"),
        "p.is_logo", "p.brand", F.coalesce("p.brand_canonical", "p.brand").alias("brand_canonical"), "p.is_truncated",
        G.clamp_score(F.col("p.logo_probability")).alias("logo_probability"), G.clamp_score(F.col("p.confidence")).alias("confidence"),
        F.to_json(T.canonical_signals(used)).alias("signals_used"), F.to_json(F.coalesce("p.signals_used_raw", used)).alias("signals_used_raw"), "p.reasoning",
        F.get(hits, F.lit(0))["brand_name"].alias("faiss_top1"), F.get(hits, F.lit(0))["similarity"].alias("faiss_top1_score"),
        F.to_json(F.transform(hits, lambda x: x["brand_name"])).alias("faiss_top5_brands"), F.to_json(F.transform(hits, lambda x: x["similarity"])).alias("faiss_top5_scores"),
        F.to_json(F.array(*map(F.lit, audio)).cast("array<string>")).alias("audio_brands"),
        F.array_join(F.transform(lines, lambda x: x["text"]), " | ").alias("ocr_text"), F.col("ocr.source").alias("ocr_source"),
        F.lit(experiment or "default").alias("experiment"), F.lit(mode).alias("brand_mode"), F.to_json(on).alias("enabled_signals"), F.lit(None).cast("string").alias("label"),
    )
