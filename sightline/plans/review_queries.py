"""Review metrics, corrections, flat tables and decision chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cascade as C
from ..operators import evidence as E
from ..operators import review as R
from ..sources import writers
from .base import query, shared_folder, sql, table

PRF = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""


def _counts(label):
    return f"count(*) FILTER (WHERE {label} <> '') AS labelled, count(*) AS total, count(*) FILTER (WHERE {label} = 'TP') AS tp, count(*) FILTER (WHERE {label} = 'FP') AS fp, count(*) FILTER (WHERE {label} = 'FN') AS fn, count(*) FILTER (WHERE {label} = 'wrong_brand') AS wrong_brand"


WB = "(CASE WHEN label = 'wrong_brand' THEN 'FP' ELSE label END)"


def _six(df):
    return df.select(*(F.round(c, 6).alias(c) if c in ("precision", "recall", "f1") else c for c in df.columns))


@query(f"WITH c AS (SELECT {_counts('label')} FROM [reviews]) SELECT *, {PRF} FROM c")
def review_prf(spark, sf):
    return _six(R.review_metrics(table(spark, sf, "reviews")))


@query(f"WITH c AS (SELECT {_counts(WB)} FROM [reviews]) SELECT *, {PRF} FROM c")
def review_prf_wrong_as_fp(spark, sf):
    return _six(R.review_metrics(table(spark, sf, "reviews"), True))


@query(f"""WITH c AS (SELECT {_counts(WB)} FROM [reviews]), m AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM c)
    SELECT CAST(det_id AS STRING) AS det_id, label, {WB} AS effective_label, label = 'TP' AS is_correct, 'detail' AS kind FROM [reviews]
    UNION ALL SELECT u.k, u.v, NULL, NULL, 'summary' FROM m, (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS i) x, LATERAL (SELECT CASE i WHEN 1 THEN 'TP' WHEN 2 THEN 'FP' WHEN 3 THEN 'FN' WHEN 4 THEN 'wrong_brand' WHEN 5 THEN 'Precision' WHEN 6 THEN 'Recall' WHEN 7 THEN 'F1' ELSE 'wb_counted_as_FP' END AS k,
        CASE i WHEN 1 THEN CAST(tp AS STRING) WHEN 2 THEN CAST(fp AS STRING) WHEN 3 THEN CAST(fn AS STRING) WHEN 4 THEN CAST(wrong_brand AS STRING) WHEN 5 THEN printf('%.4f', p) WHEN 6 THEN printf('%.4f', r) WHEN 7 THEN printf('%.4f', 2 * p * r / (p + r)) ELSE 'True' END AS v) u""")
def review_export(spark, sf):
    return R.export(table(spark, sf, "reviews").select("det_id", "label"), True, True)


@query("SELECT det_id FROM [reviews] WHERE coalesce(confidence, 50) BETWEEN 40 AND 80 AND is_logo IN ('logo', 'partial_logo') AND label IN ('TP', 'FP')")
def review_filter(spark, sf):
    return R.review_filter(table(spark, sf, "reviews"), ["logo", "partial_logo"], ["TP", "FP"], True, 40, 80).select("det_id")


@query("SELECT det_id, brand FROM [reviews] WHERE is_logo IN ('logo', 'partial_logo')")
def logo_only(spark, sf):
    return table(spark, sf, "reviews").where(F.col("is_logo").isin("logo", "partial_logo")).select("det_id", "brand")


@query("SELECT coalesce(verdict, '—') AS verdict, count(*) AS n, CASE verdict WHEN 'Correct' THEN 1 WHEN 'Incorrect' THEN 2 ELSE 4 END AS place FROM [known] GROUP BY ALL")
def verdict_counts(spark, sf):
    return R.verdict_counts(table(spark, sf, "known"), ["Correct", "Incorrect", "Other"])


@query("SELECT count(*) AS total, count(*) FILTER (WHERE is_logo = 'logo') AS logo, count(*) FILTER (WHERE is_logo = 'partial_logo') AS partial_logo, count(*) FILTER (WHERE is_logo = 'not_logo') AS not_logo, count(*) FILTER (WHERE is_logo IS NULL) AS unparsed, count(*) FILTER (WHERE brand = 'UNKNOWN') AS unknown_brand, count(*) FILTER (WHERE is_truncated) AS truncated FROM [reviews]")
def prediction_counts(spark, sf):
    return R.prediction_counts(table(spark, sf, "reviews"))


NAMED = """n AS (SELECT filepath, brand, CASE lower(trim(coalesce(correction, ''))) WHEN 'typo_correction' THEN 'typo' WHEN 'wrong_logo' THEN 'wrong' WHEN 'fp' THEN 'false_positive' WHEN 'confirmed' THEN 'confirm' ELSE '' END AS c,
    CASE source WHEN 'database' THEN 'internal_db' WHEN 'top2k' THEN 'top2k_brands' WHEN 'audio' THEN 'audio' END AS s, verdict, family FROM [known])"""


@query(f"WITH {NAMED} SELECT filepath, c AS correction, s AS source FROM n")
def correction_names(spark, sf):
    return table(spark, sf, "known").select("filepath", R.correction(F.col("correction")).alias("correction"), R.source_key(F.col("source")).alias("source"))


COUNTS = "count(*) AS processed, count(*) FILTER (WHERE c <> 'confirm') AS errors, count(*) FILTER (WHERE c = 'false_positive') AS false_positives, count(*) FILTER (WHERE c = 'typo') AS typo_corrections, count(*) FILTER (WHERE c = 'wrong') AS wrong_attributions, count(*) FILTER (WHERE c = 'confirm') AS confirmed_attributions"


@query(f"WITH {NAMED} SELECT 'all' AS source, {COUNTS} FROM n WHERE c <> '' UNION ALL SELECT s, {COUNTS} FROM n WHERE c <> '' AND s IS NOT NULL GROUP BY s")
def source_metrics(spark, sf):
    return R.source_metrics(table(spark, sf, "known"))


BREAK = f"""{NAMED}, k AS (SELECT brand, count(*) AS total_images, count(*) FILTER (WHERE c = 'confirm') AS confirmed, count(*) FILTER (WHERE c = 'false_positive') AS false_positives, count(*) FILTER (WHERE c = 'typo') AS typos, count(*) FILTER (WHERE c = 'wrong') AS wrong_attribution, count(*) FILTER (WHERE c = '') AS not_reviewed FROM n GROUP BY brand),
    f AS (SELECT trim(brand) AS brand, count(*) AS false_negatives FROM [confirmed] WHERE trim(brand) <> '' GROUP BY ALL),
    b AS (SELECT coalesce(k.brand, f.brand) AS brand, coalesce(total_images, 0) AS total_images, coalesce(confirmed, 0) AS confirmed, coalesce(false_positives, 0) AS false_positives, coalesce(typos, 0) AS typos, coalesce(wrong_attribution, 0) AS wrong_attribution, coalesce(not_reviewed, 0) AS not_reviewed, coalesce(false_negatives, 0) AS false_negatives FROM k FULL JOIN f ON k.brand = f.brand)"""


@query(f"WITH {BREAK} SELECT * FROM b")
def brand_breakdown(spark, sf):
    return R.brand_breakdown(table(spark, sf, "known"), table(spark, sf, "confirmed"))


@query(f"WITH {BREAK} SELECT count(*) AS brands, count(*) FILTER (WHERE total_images = not_reviewed) AS not_reviewed, count(*) FILTER (WHERE false_positives > 0) AS with_false_positive, count(*) FILTER (WHERE false_negatives > 0) AS with_false_negative, count(*) FILTER (WHERE typos > 0) AS with_typo, count(*) FILTER (WHERE wrong_attribution > 0) AS with_wrong_attribution, count(*) FILTER (WHERE confirmed > 0) AS with_confirmed FROM b")
def brand_overview(spark, sf):
    return R.brand_overview(table(spark, sf, "known"), table(spark, sf, "confirmed"))


@query("SELECT trim(brand) AS brand, count(*) AS false_negatives FROM [confirmed] WHERE trim(brand) <> '' GROUP BY ALL")
def misses_by_brand(spark, sf):
    return R.misses(table(spark, sf, "confirmed"))


@query("SELECT family, count(*) AS n FROM [known] GROUP BY family")
def family_counts(spark, sf):
    return table(spark, sf, "known").groupBy("family").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "family")


@query("WITH t AS (SELECT count(*) AS total FROM [known]) SELECT family, printf('%d (%.1f%%)', count(*), count(*) * 100e0 / any_value(total)) AS shown FROM [known], t GROUP BY family")
def count_shares(spark, sf):
    k = table(spark, sf, "known")
    total = k.agg(F.count("*").alias("total"))
    return k.groupBy("family").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("family", R.count_share(F.col("n"), F.col("total")).alias("shown"))


@query("SELECT filepath FROM [known] WHERE brand = 'brand 3' OR (verdict = 'Correct' AND coalesce(correction, '') = 'confirmed')")
def known_filter(spark, sf):
    k = table(spark, sf, "known")
    return k.where((F.col("brand") == "brand 3") | ((F.col("verdict") == "Correct") & (R.correction(F.col("correction")) == "confirm"))).select("filepath")


@query("SELECT filepath FROM [known] WHERE coalesce(lower(trim(correction)), '') <> 'fp'")
def drop_false_positives(spark, sf):
    return R.without_false_positives(table(spark, sf, "known")).select("filepath")


@query("SELECT k.filepath AS filepath, coalesce(o.brand, k.brand) AS brand, k.family AS family FROM [known] k LEFT JOIN (SELECT filepath, concat('new ', family) AS brand FROM [known] WHERE verdict = 'Incorrect') o ON k.filepath = o.filepath")
def overlay_update(spark, sf):
    k = table(spark, sf, "known").select("filepath", "brand", "family", "verdict")
    changes = k.where("verdict = 'Incorrect'").select("filepath", F.concat(F.lit("new "), F.col("family")).alias("brand"))
    return R.overlay(k.drop("verdict"), changes, "filepath", ["brand"])


@query("SELECT DISTINCT brand FROM [reviews] WHERE brand <> 'UNKNOWN'")
def assigned_brands(spark, sf):
    return R.assigned_brands(table(spark, sf, "reviews")).orderBy(F.lower("brand"))


@query("SELECT id, brand FROM [confirmed] c WHERE NOT EXISTS (SELECT 1 FROM [known] k WHERE k.brand = c.brand)")
def unseen_only(spark, sf):
    return table(spark, sf, "confirmed").join(table(spark, sf, "known").select("brand"), "brand", "left_anti").select("id", "brand")


@query("SELECT filepath, regexp_extract(filepath, '([^/]+)\\.png$', 1) AS stem FROM [known] WHERE CAST(regexp_extract(filepath, '([0-9]+)\\.png$', 1) AS BIGINT) IN (SELECT s_suppkey FROM {supplier})")
def stem_join(spark, sf):
    k = table(spark, sf, "known").select("filepath", F.regexp_extract("filepath", r"([^/]+)\.png$", 1).alias("stem"))
    labels = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("stem"))
    return k.join(labels, "stem", "left_semi").select("filepath", "stem")


@query("""SELECT r.det_id AS det_id, r.label AS label, r.brand AS brand, r.confidence AS confidence, d.lang AS lang, d.source AS source, CASE WHEN d.doc_id IS NULL THEN '[]' ELSE concat('["', d.lang, '","', d.source, '"]') END AS tags
    FROM [reviews] r LEFT JOIN {documents} d ON r.det_id = d.doc_id""")
def flat_predictions(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("det_id"), "lang", "source")
    j = table(spark, sf, "reviews").join(d, "det_id", "left")
    tags = F.when(F.col("lang").isNull(), F.lit("[]")).otherwise(F.to_json(F.array("lang", "source")))
    return j.select("det_id", "label", "brand", "confidence", "lang", "source", tags.alias("tags"))


PARSED = """SELECT det_id, is_logo, brand, CASE WHEN det_id % 3 = 0 THEN NULL ELSE concat('The ', brand) END AS brand_canonical, is_truncated, CASE WHEN det_id % 10 = 0 THEN 'high' ELSE CAST(det_id * 7 % 130 AS STRING) END AS logo_probability, CAST(confidence AS STRING) AS confidence, concat('why ', label) AS reasoning FROM [reviews] WHERE det_id % 8 <> 0"""


@query(f"""WITH p AS ({PARSED}), h AS (SELECT doc_id AS det_id, lang, source FROM {{documents}} WHERE doc_id % 4 <> 0), d AS (SELECT det_id, CAST(det_id AS STRING) AS s, printf('%06d', CAST(det_id AS INT)) AS f FROM [reviews])
    SELECT d.det_id AS det_id, d.det_id AS frame_idx, d.det_id / 25e0 AS timecode_s, round(d.det_id % 1000 / 1000e0, 4) AS det_score, concat('[', CAST(d.det_id % 640 AS STRING), ',', CAST(d.det_id % 360 AS STRING), ',', CAST(d.det_id % 640 + 9 AS STRING), ',', CAST(d.det_id % 360 + 9 AS STRING), ']') AS box_xyxy,
        concat('run/crops/', s, '.png') AS crop_path, concat('run/large/', s, '.png') AS enlarged_crop_path, concat('run/detections/frame_', f, '/frame.jpg') AS frame_path, concat('run/annotated_frames__x/frame_', f, '.jpg') AS annotated_frame_path,
        is_logo, brand, coalesce(brand_canonical, brand) AS brand_canonical, is_truncated, CASE WHEN TRY_CAST(logo_probability AS DOUBLE) IS NOT NULL THEN CAST(least(100, greatest(0, TRY_CAST(logo_probability AS DOUBLE))) AS INT) END AS logo_probability, CAST(confidence AS INT) AS confidence,
        CASE WHEN p.det_id IS NULL THEN '[]' ELSE '["ocr_text","tight_crop"]' END AS signals_used, CASE WHEN p.det_id IS NULL THEN '[]' ELSE '["OCR","Crop Visual!","text"]' END AS signals_used_raw, reasoning,
        lang AS faiss_top1, CASE WHEN h.det_id IS NOT NULL THEN 0.875e0 END AS faiss_top1_score, CASE WHEN h.det_id IS NULL THEN '[]' ELSE CAST(to_json([lang, source]) AS STRING) END AS faiss_top5_brands, CASE WHEN h.det_id IS NULL THEN '[]' ELSE '[0.875,0.5]' END AS faiss_top5_scores,
        '["tv"]' AS audio_brands, CASE WHEN h.det_id IS NULL THEN '' ELSE concat(source, ' | ', lang) END AS ocr_text, CASE WHEN h.det_id IS NOT NULL THEN 'tight_crop' END AS ocr_source, 'x' AS experiment, 'closed' AS brand_mode, '["tight_crop","ocr_text"]' AS enabled_signals, CAST(NULL AS STRING) AS label
    FROM d LEFT JOIN p ON d.det_id = p.det_id LEFT JOIN h ON d.det_id = h.det_id""")
def prediction_table(spark, sf):
    """The whole flat table of predictions."""
    i = F.col("det_id")
    d = table(spark, sf, "reviews").select("det_id", i.alias("frame_idx"), (i / 25.0).alias("timecode_seconds"), (i % 1000 / 1000.0).alias("score"), F.array(i % 640, i % 360, i % 640 + 9, i % 360 + 9).alias("box_xyxy"), F.concat(F.lit("crops/"), i.cast("string"), F.lit(".png")).alias("crop_path"), F.concat(F.lit("large/"), i.cast("string"), F.lit(".png")).alias("crop_enlarged_path"))
    p = sql(spark, sf, PARSED).withColumn("signals_used", F.array(F.lit("OCR"), F.lit("Crop Visual!"), F.lit("text"))).withColumn("signals_used_raw", F.lit(None).cast("array<string>"))
    hit = lambda c, x: F.struct(F.col(c).alias("brand_name"), F.lit(x).alias("similarity"))
    line = lambda c: F.struct(F.col(c).alias("text"), F.lit(0.5).alias("confidence"))
    h = table(spark, sf, "documents").where("doc_id % 4 <> 0").select(F.col("doc_id").alias("det_id"), F.array(hit("lang", 0.875), hit("source", 0.5)).alias("faiss_top_k"), F.struct(F.array(line("source"), line("lang")).alias("lines"), F.lit("tight_crop").alias("source")).alias("ocr"))
    return E.flat_predictions(d, p, h, ["tv"], "x", "closed", ["ocr_text", "tight_crop"], "run")


# Decision chains.
ITEMS = """SELECT p_partkey AS id, p_name AS ocr, p_brand AS top_brand, CASE WHEN p_size % 9 = 0 THEN NULL ELSE 0.86e0 + p_size % 14 / 100e0 END AS top, p_size % 6 AS votes, (p_size % 6) / 5e0 AS share,
    CASE WHEN p_size % 4 = 0 THEN 'False_Logo' ELSE p_brand END AS hit, CASE WHEN p_size % 3 = 0 THEN 'other' ELSE upper(p_brand) END AS winner, CAST(p_partkey % 101 AS DOUBLE) AS fuzzy, CASE WHEN p_partkey % 8 = 0 THEN 'a' ELSE p_name END AS words FROM {part}"""


@query(f"""WITH i AS ({ITEMS}), g AS (SELECT *, CASE WHEN lower(hit) = 'false_logo' AND top >= 0.93 THEN 'false_logo' WHEN top IS NULL THEN 'no_hit' WHEN top >= 0.97 THEN 'strict' WHEN top >= 0.9 AND votes >= 4 AND share >= 0.4 AND lower(winner) = lower(hit) THEN 'consensus' WHEN length(words) < 3 THEN 'short_text' WHEN fuzzy >= 80 THEN 'text' ELSE 'none' END AS gate FROM i)
    SELECT id, gate, CASE gate WHEN 'strict' THEN hit WHEN 'consensus' THEN lower(winner) WHEN 'text' THEN top_brand ELSE 'UNKNOWN' END AS brand, CASE WHEN gate IN ('strict', 'consensus') THEN top WHEN gate = 'text' THEN fuzzy / 100 ELSE 0 END AS score FROM g""")
def db_gate_cascade(spark, sf):
    i = sql(spark, sf, ITEMS)
    g = C.gallery_gates(*(F.col(c) for c in ("hit", "top", "winner", "votes", "share", "words", "top_brand", "fuzzy")))
    return i.select("id", *(c.alias(n) for n, c in g.items()))


@query(f"""WITH i AS ({ITEMS}) SELECT id, CASE WHEN top >= 0.97 THEN top_brand WHEN fuzzy >= 60 THEN upper(top_brand) WHEN votes >= 4 THEN 'heard' ELSE 'UNKNOWN' END AS brand,
    CASE WHEN top >= 0.97 THEN 'database' WHEN fuzzy >= 60 THEN 'text' WHEN votes >= 4 THEN 'audio' END AS technique, CASE WHEN top >= 0.97 THEN top WHEN fuzzy >= 60 THEN fuzzy WHEN votes >= 4 THEN share END AS score FROM i""")
def recognizer_cascade(spark, sf):
    some = lambda cond, brand, score: lambda df: df.select("id", F.when(F.expr(cond), F.expr(brand)).otherwise("UNKNOWN").alias("brand"), F.expr(score).alias("score"))
    chain = [("database", some("top >= 0.97", "top_brand", "top")), ("text", some("fuzzy >= 60", "upper(top_brand)", "fuzzy")), ("audio", some("votes >= 4", "'heard'", "share"))]
    return C.first_match(sql(spark, sf, ITEMS), chain)


@query(f"""WITH i AS ({ITEMS}) SELECT id, CASE WHEN top >= 0.97 THEN top_brand WHEN fuzzy >= 60 THEN upper(top_brand) ELSE 'UNKNOWN' END AS brand, CASE WHEN top >= 0.97 THEN 'database' WHEN fuzzy >= 60 THEN 'text' END AS technique, CASE WHEN top >= 0.97 THEN top WHEN fuzzy >= 60 THEN fuzzy END AS score FROM i""")
def first_known_columns(spark, sf):
    pick = C.first_known([("database", F.expr("case when top >= 0.97 then top_brand end"), F.col("top")), ("text", F.expr("case when fuzzy >= 60 then upper(top_brand) end"), F.col("fuzzy"))])
    return sql(spark, sf, ITEMS).select("id", *(c.alias(n) for n, c in pick.items()))


@query(f"WITH i AS ({ITEMS}) SELECT id, CASE WHEN length(trim(CASE WHEN votes = 0 THEN '' ELSE ocr END)) = 0 THEN CASE WHEN top >= 0.93 THEN hit ELSE 'UNKNOWN' END WHEN length(ocr) >= 3 AND NOT (length(ocr) <= 3 AND fuzzy < 85) AND fuzzy >= 75 AND 100 - votes * 5 >= 80 THEN hit ELSE 'UNKNOWN' END AS brand FROM i")
def text_or_visual(spark, sf):
    i = sql(spark, sf, ITEMS)
    return i.select("id", C.text_or_visual(F.when(F.col("votes") == 0, "").otherwise(F.col("ocr")), F.col("hit"), F.col("top"), F.col("fuzzy"), 100 - F.col("votes") * 5).alias("brand"))


VERDICTS = "SELECT conv_id * 1000 + turn AS logo_id, CASE turn % 5 WHEN 0 THEN 'Incorrect.' WHEN 1 THEN 'correct!' WHEN 2 THEN 'Other/Correct' WHEN 3 THEN '' ELSE 'The answer is CORRECT' END AS raw FROM {conversations}"
VERDICT = "CASE WHEN lower(raw) LIKE '%other%' THEN 'Other' WHEN lower(raw) LIKE '%incorrect%' THEN 'Incorrect' WHEN lower(raw) LIKE '%correct%' THEN 'Correct' ELSE 'Incorrect' END"


@query(f"SELECT logo_id, {VERDICT} AS verdict FROM ({VERDICTS})")
def verdict_normalize(spark, sf):
    return sql(spark, sf, VERDICTS).select("logo_id", T.verdict(F.col("raw")).alias("verdict"))


ROWS = "SELECT conv_id * 1000 + turn AS logo_id, concat('brand ', CAST(conv_id % 7 AS STRING)) AS brand, CASE turn % 3 WHEN 0 THEN 'database' WHEN 1 THEN 'Audio ' ELSE 'manual' END AS source FROM {conversations}"


@query(f"""WITH v AS (SELECT logo_id, {VERDICT} AS verdict FROM ({VERDICTS}) WHERE logo_id % 11 <> 0), j AS (SELECT r.*, verdict, verdict IS NOT NULL AND lower(trim(source)) IN ('database', 'audio') AS applied FROM ({ROWS}) r LEFT JOIN v ON r.logo_id = v.logo_id)
    SELECT logo_id, CASE WHEN applied AND verdict <> 'Correct' THEN 'UNKNOWN' ELSE brand END AS brand, source, 'llm' AS postfilter_method, applied AS postfilter_applied, CASE WHEN applied THEN verdict ELSE 'Skipped' END AS postfilter_verdict, NOT applied OR verdict = 'Correct' AS kept FROM j""")
def postfilter(spark, sf):
    verdicts = sql(spark, sf, VERDICTS).where("logo_id % 11 <> 0")
    return C.postfilter(sql(spark, sf, ROWS), verdicts, ["database", "audio"], "llm").select("logo_id", "brand", "source", "postfilter_method", "postfilter_applied", "postfilter_verdict", "kept")


@query(f"""WITH a AS (SELECT logo_id, {VERDICT} AS verdict FROM ({VERDICTS}) WHERE logo_id % 11 <> 0), v AS (SELECT r.logo_id // 1000 AS frame, r.logo_id AS logo_id, CASE WHEN r.logo_id % 5 = 0 THEN NULL WHEN lower(trim(source)) IN ('database', 'audio') AND r.logo_id % 2 = 0 THEN 'Correct' WHEN lower(trim(source)) = 'database' THEN verdict END AS verdict FROM ({ROWS}) r LEFT JOIN a ON r.logo_id = a.logo_id)
    SELECT frame, count(*) AS results, count(*) FILTER (WHERE verdict IS NULL OR verdict = 'Correct') AS kept, count(verdict) AS applied, coalesce(string_agg(CAST(logo_id AS STRING), ',' ORDER BY logo_id) FILTER (WHERE verdict IS NULL OR verdict = 'Correct'), '') AS ids FROM v GROUP BY frame""")
def postfilter_frames(spark, sf):
    """Two strategies one after the other, rows without a readable image, and frames of which nothing is left."""
    rows = sql(spark, sf, ROWS).withColumn("frame", F.floor(F.col("logo_id") / 1000)).withColumn("readable", F.col("logo_id") % 5 != 0)
    first = ("llm", ["database"], lambda _: sql(spark, sf, VERDICTS).where("logo_id % 11 <> 0"))
    second = ("again", ["database", "audio"], lambda asked: asked.where("logo_id % 2 = 0").select("logo_id", F.lit("correct").alias("raw")))
    out = C.postfilter_outputs(rows, rows.select("frame", F.lit(0.0).alias("timestamp")).distinct(), [first, second])
    kept = out["filtered_frames"].select("frame", F.size("results").cast("long").alias("kept"), F.array_join(F.transform("results", lambda r: r["logo_id"].cast("string")), ",").alias("ids"))
    every = out["frames"].select("frame", F.size("results").cast("long").alias("results"), F.size(F.filter("results", lambda r: r["postfilter"]["applied"])).cast("long").alias("applied"))
    return every.join(kept, "frame")


ROUTES = "SELECT event_id AS id, value / 500e0 AS pg, user_id % 10 / 10e0 AS ns, user_id % 7 / 7e0 AS pm, event_id % 9 / 9e0 AS pl, event_type = 'click' AS poster, user_id % 3 = 0 AS stylized, user_id % 5 = 0 AS design FROM {events}"


@query(f"SELECT id, CASE WHEN pg >= 0.8 AND ns >= 0.8 THEN 'LLM' WHEN pm >= 0.67 THEN 'EXCLUDE' WHEN pl >= 0.5 AND NOT poster THEN 'API' WHEN poster THEN 'EXCLUDE' WHEN stylized OR design THEN 'API' ELSE 'EXCLUDE' END AS route FROM ({ROUTES})")
def llm_routing(spark, sf):
    return sql(spark, sf, ROUTES).select("id", C.route(*(F.col(c) for c in ("pg", "ns", "pm", "pl", "poster", "stylized", "design"))).alias("route"))


YES = "SELECT conv_id, CASE turn % 4 WHEN 0 THEN 'Yes, it is' WHEN 1 THEN 'I know it' WHEN 2 THEN 'perhaps' ELSE text END AS answer FROM {conversations}"


@query(f"WITH a AS (SELECT conv_id, CASE WHEN lower(answer) LIKE '%yes%' THEN 1 ELSE 0 END AS y, CASE WHEN lower(answer) LIKE '%yes%' OR lower(answer) LIKE '%no%' THEN 1 ELSE 0 END AS i FROM ({YES})) SELECT conv_id, CAST(sum(y) AS BIGINT) AS yes, CAST(sum(i) AS BIGINT) AS include, round(sum(y) / nullif(sum(i), 0), 6) AS probability FROM a GROUP BY conv_id")
def yes_no_probability(spark, sf):
    return C.yes_no(sql(spark, sf, YES), "conv_id", "answer").select("conv_id", "yes", "include", F.round("probability", 6).alias("probability"))


NAMES = "SELECT conv_id AS id, CASE turn % 3 WHEN 0 THEN 'audio_brands' WHEN 1 THEN 'faiss_matches' ELSE 'ocr_text' END AS signal, turn % 3 AS signal_order, turn AS pos, CASE WHEN turn % 4 = 3 THEN ' ' ELSE concat(CASE WHEN turn % 2 = 0 THEN 'Brand ' ELSE 'brand ' END, CAST((conv_id + turn) % 3 AS STRING)) END AS name FROM {conversations}"


@query(f"""WITH n AS (SELECT *, lower(trim(name)) AS k FROM ({NAMES}) WHERE signal IN ('audio_brands', 'faiss_matches') AND trim(name) <> ''), f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY signal_order, pos) = 1)
    SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY signal_order, pos) AS INT) AS ord, name FROM f""")
def closed_set_candidates(spark, sf):
    return C.candidates(sql(spark, sf, NAMES), ["audio_brands", "faiss_matches"])


@query("SELECT 'known' AS part, filepath FROM [known] WHERE brand <> 'brand 0' UNION ALL SELECT 'unknown', filepath FROM [known] WHERE brand = 'brand 0'")
def known_unknown_split(spark, sf):
    """Written in folders by whether the brand is known, and read again."""
    path = shared_folder(spark)
    k = table(spark, sf, "known").select("filepath", F.when(F.col("brand") != "brand 0", F.col("brand")).otherwise("UNKNOWN").alias("brand"))
    writers.split_known(k, path)
    return spark.read.parquet(path).select(F.when(F.col("is_known").cast("boolean"), "known").otherwise("unknown").alias("part"), "filepath")


@query("""SELECT filepath FROM [known] k LEFT JOIN (SELECT concat('crops/', CAST(s_suppkey AS STRING), '.png') AS f, 'done' AS status FROM {supplier}) r ON k.filepath = r.f
    WHERE k.brand = 'brand 3' AND k.verdict = 'Correct' AND coalesce(r.status, '') = ''""")
def known_tab_filters(spark, sf):
    """By brand, verdict and review status, rows without a review having none."""
    reviews = table(spark, sf, "supplier").select(F.concat(F.lit("crops/"), F.col("s_suppkey").cast("string"), F.lit(".png")).alias("filepath"), F.lit("done").alias("status"))
    return R.known_tab(table(spark, sf, "known"), "brand 3", "Correct", "", reviews).select("filepath")


@query("SELECT count(*) AS images, count(s_suppkey) AS pairs, count(*) - count(s_suppkey) AS missing FROM [known] LEFT JOIN {supplier} ON filepath = concat('crops/', CAST(s_suppkey AS STRING), '.png')")
def stem_counts(spark, sf):
    """Images with a label file of the same stem, and how many have none."""
    labels = table(spark, sf, "supplier").select(F.concat(F.lit("labels/"), F.col("s_suppkey").cast("string"), F.lit(".txt")).alias("path"))
    return R.pair_by_stem(table(spark, sf, "known").select(F.col("filepath").alias("path")), labels)[1]
