"""Sampling, peaks, keyframes and intervals over frames."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinals import rows_at
from .slices import with_slices

#: Fixed value: what stands between the sources of an interval.
SEPARATOR = ", "


def every_interval(total: Column, fps: Column, seconds: float = 2.0) -> Column:
    """Frames 0, step, 2 step, ... below total; step = fps * seconds rounded half to even, 1 at least."""
    step = F.greatest(F.lit(1), F.bround(fps * seconds, 0).cast("int"))
    return F.when(total > 0, F.sequence(F.lit(0), (total - 1).cast("int"), step)).otherwise(F.array().cast("array<int>"))


def segment_middles(total: Column, length: int) -> Column:
    """The middle frame of each segment of `length` frames, each once, ascending."""
    starts = F.when(total > 0, F.sequence(F.lit(0), (total - 1).cast("int"), F.lit(length))).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_distinct(F.transform(starts, lambda s: F.floor((s + F.least(s + length - 1, total - 1)) / 2).cast("int"))))


def context(frame: Column, total: Column, width: int = 5) -> Column:
    """(offset, frame) around a frame without itself; the frame is null outside the video."""
    offsets = F.filter(F.sequence(F.lit(-width), F.lit(width)), lambda o: o != 0)
    return F.transform(offsets, lambda o: F.struct(F.format_string("%+d", o).alias("offset"), F.when((frame + o >= 0) & (frame + o < total), (frame + o).cast("int")).alias("frame")))


def expand(frame: Column, total: Column, window: int) -> Column:
    """Frames within `window` of a frame, inside the video."""
    return F.sequence(F.greatest(F.lit(0), frame - window).cast("int"), F.least(total - 1, frame + window).cast("int"))


def within_window(detections: DataFrame, frames: DataFrame, window: int) -> DataFrame:
    """Frames joined with detections at most `window` frames away, by equal keys: each detection is expanded first."""
    wide = detections.withColumn("near", F.explode(F.sequence(F.col("frame") - window, F.col("frame") + window)))
    return frames.join(wide.withColumnRenamed("frame", "detected_at"), (frames["frame"] == F.col("near")) & (frames["video"] == wide["video"])).drop(wide["video"]).drop("near")


def nearest_offsets(wanted: Column, available: Column) -> Column:
    """Wanted offsets that are available; without any, as many of the nearest (negative before positive), one at least, ascending."""
    exact = F.filter(wanted, lambda o: F.array_contains(available, o))
    order = F.array_sort(F.transform(available, lambda o: F.struct(F.abs(o).alias("a"), o.alias("o"))))
    near = F.slice(order, 1, F.greatest(F.size(wanted), F.lit(1)))
    return F.when(F.size(exact) > 0, exact).otherwise(F.array_sort(F.transform(near, lambda s: s["o"])))


def with_quantile(series: DataFrame, key: list[str], value: str, q: float) -> DataFrame:
    """Rows with the exact linear quantile of their series as `threshold`."""
    level = series.groupBy(*key).agg(F.percentile(value, q).alias("threshold"))
    return series.join(level, key)


def peaks(series: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value exceeds both neighbours by `threshold` or more; pos is the row's place from 0. The ends are no peaks."""
    w = Window.partitionBy(*key).orderBy(*order)
    rows = series.withColumn("pos", F.row_number().over(w) - 1).withColumn("before", F.lag(value).over(w)).withColumn("after", F.lead(value).over(w))
    v = F.col(value)
    return rows.where((v > F.col("before")) & (v > F.col("after")) & (v - F.col("before") >= F.col("threshold")) & (v - F.col("after") >= F.col("threshold"))).drop("before", "after")


def keyframes(peak: DataFrame, key: list[str]) -> DataFrame:
    """The middle between consecutive peaks, with 0 before the first; nothing after the last."""
    w = Window.partitionBy(*key).orderBy("pos")
    return peak.select(*key, "pos", F.floor((F.col("pos") + F.lag("pos", 1, 0).over(w)) / 2).cast("int").alias("keyframe"))


def brand_intervals(detections: DataFrame, keys: list[str], limit: int | None = None, place: Column | None = None) -> DataFrame:
    """One row per key of named detections (brand, frame, time, source, tie): first and last by frame, and the sources in order of appearance.

    place: what first and last go by instead of frame and tie, of equal ones the smallest tie; rows without a place are neither.
    A source is written again whenever it differs from the whole list so far; a
    missing one is `unknown`.  Slices of a key are summed up by themselves (the
    runs they begin with, and all their sources as text) and then put together, so
    that no task holds more of a key than a slice and the text that results.
    """
    rows = detections.where(F.coalesce("brand", F.lit("UNKNOWN")) != "UNKNOWN").withColumn("source", F.coalesce("source", F.lit("unknown")))
    # Once the list is longer than any source it equals none, and what follows is only written down.  Two runs
    # lengthen it by a letter at least, so no more runs than this have to be looked at one by one.
    longest = rows.agg(F.coalesce(F.max(F.length("source")), F.lit(0))).first()[0]
    at = F.struct("frame", "tie") if place is None else place
    end = lambda tie: F.when(at.isNotNull() & F.col("time").isNotNull(), F.struct(at.alias("at"), tie.alias("tie"), "time"))
    rows, _ = with_slices(rows, keys, F.col("frame"), limit=limit)
    first_runs, put_together = F.pandas_udf(_first_runs, "array<struct<name: string, n: bigint>>"), F.pandas_udf(_put_together, "string")
    part = rows.groupBy(*keys, "_slice").agg(F.min(end(F.col("tie"))).alias("a"), F.max(end(-F.col("tie"))).alias("b"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("frame", "tie", "source"))).alias("s"))
    names = part.select(*keys, "_slice", "a", "b", "n", F.transform("s", lambda x: x["source"]).alias("s"))
    heads = names.select(*keys, "_slice", "a", "b", "n", first_runs(F.col("s"), F.lit(longest + 2)).alias("runs"), F.array_join("s", SEPARATOR).alias("all"))
    out = heads.groupBy(*keys).agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("_slice", "runs", "all"))).alias("p"))
    runs = F.flatten(F.transform("p", lambda x: x["runs"]))
    joined = put_together(F.transform(runs, lambda x: x["name"]), F.transform(runs, lambda x: x["n"]), F.transform("p", lambda x: F.size(x["runs"])), F.transform("p", lambda x: x["all"]), F.lit(longest))
    return out.select(*keys, F.col("a.time").alias("start"), F.col("b.time").alias("stop"), "n", joined.alias("source"))


def _first_runs(names: pd.Series, most: pd.Series) -> pd.Series:
    """The runs of equal names that a list begins with, `most` of them at most."""
    return pd.Series([[{"name": x, "n": sum(1 for _ in g)} for x, g in islice(groupby(s), k)] for s, k in zip(names, most, strict=True)])


def _put_together(names: pd.Series, counts: pd.Series, amounts: pd.Series, texts: pd.Series, longest: pd.Series) -> pd.Series:
    """The list that the slices of a key give in order; names and counts: their first runs, end to end, amounts: how many of each slice."""

    def whole(runs: Iterator[tuple[str, int]], parts: Iterator[tuple[int, str]], most: int) -> str:
        out: list[str] = []
        size = 0
        for amount, text in parts:
            done = 0  # letters of the slice's text that its runs so far stand for
            for name, n in list(islice(runs, amount)):
                if size > most:
                    break
                done += n * (len(name) + len(SEPARATOR))
                if not out:
                    out, size, n = [name], len(name), n - 1
                if n and not (size == len(name) and SEPARATOR.join(out) == name):
                    out += [name] * n
                    size += n * (len(name) + len(SEPARATOR))
            if size > most and done <= len(text):
                out.append(text[done:])
                size += max(1, len(text) - done)
        return SEPARATOR.join(out)

    rows = zip(names, counts, amounts, texts, longest, strict=True)
    return pd.Series([whole(zip(a, b.tolist(), strict=True), zip(c.tolist(), d, strict=True), k) for a, b, c, d, k in rows])


def first_per(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_turn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_turn = 1").drop("_turn")


def busy_gate(rows: DataFrame, key: list[str], condition: Column, least: int = 10) -> DataFrame:
    """Rows that pass, or whose group has fewer than `least` rows."""
    n = F.count("*").over(Window.partitionBy(*key))
    return rows.withColumn("_n", n).where((F.col("_n") < least) | F.coalesce(condition, F.lit(False))).drop("_n")


def page(rows: DataFrame, order: list[str], number: int, size: int = 24) -> DataFrame:
    """One page; a number outside is moved to the first or last page."""
    n = rows.count()
    last = max(0, -(-n // size) - 1)
    return rows_at(rows, order, min(max(number, 0), last) * size, size, n=n)


def split_by_hash(key: Column, train_percent: int = 70) -> Column:
    """'train' or 'val' by a hash of the key, the same wherever the row is."""
    return F.when(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 100 < train_percent, "train").otherwise("val")
