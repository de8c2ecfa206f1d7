"""Joins with the row that is nearest in time.

Both sides are put into one table and sorted, and the last (or next) row of the
right side is carried to each row of the left side; nothing is joined by an
inequality.  A group too large for one task is cut into slices of time, and what a
slice has to know of those before and behind it is carried from slice to slice in a
table that has one row a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slices import with_slices


def _ticks(df: DataFrame, on: str) -> Column:
    return F.unix_micros(on) if dict(df.dtypes)[on] == "timestamp" else F.unix_micros(F.col(on).cast("timestamp")) if dict(df.dtypes)[on] in ("timestamp_ntz", "date") else F.col(on)


def as_of(left: DataFrame, right: DataFrame, on: str, by: list[str], take: list[str], direction: str = "nearest", tolerance: float | None = None, limit: int | None = None) -> DataFrame:
    """left with the columns `take` of the right row of its group that is nearest in `on`, and that row's `on` as on_right.

    direction: backward (at the same time or earlier), forward (same or later), or
    nearest, where of two equally near rows the earlier one is taken.  Of right rows
    at one time the one with the largest `take` comes backward, the smallest
    forward.  tolerance: in units of a numeric `on`, in microseconds of a
    timestamp.  Rows without a match, or with a null group or time, get nulls.
    limit: rows that a slice of a group holds, about.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"direction {direction}")
    keys = [f"_k{i}" for i in range(len(by))]
    found = F.struct(_ticks(right, on).alias("t"), F.col(on).alias("at"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(take)))
    kind = right.select(found.alias("f")).schema["f"].dataType
    whole = left.select(F.struct(*left.columns).alias("f")).schema["f"].dataType
    named = lambda df: [F.col(b).alias(k) for b, k in zip(by, keys, strict=True)]
    known = F.col("_t").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    # At one time right rows stand before left rows, but after them where only later ones are wanted.
    asks = left.select(*named(left), _ticks(left, on).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_f"), F.struct(*left.columns).alias("_l"))
    has = right.select(*named(right), _ticks(right, on).alias("_t"), F.lit(2 if direction == "forward" else 0).alias("_side"), found.alias("_f"), F.lit(None).cast(whole).alias("_l")).where(known)
    rows, slices = with_slices(asks.where(known).unionByName(has), keys, F.col("_t"), limit=limit)
    group = Window.partitionBy(*keys, "_slice").orderBy("_t", "_side", "_f")
    rows = rows.withColumn("_before", F.last("_f", True).over(group.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_behind", F.first("_f", True).over(group.rowsBetween(0, Window.unboundedFollowing)))
    # What comes from other slices: the last found before, the first found behind.
    ends = rows.where("_f is not null").join(slices, [*keys, "_slice"], "left_semi").groupBy(*keys, "_slice").agg(F.max("_f").alias("_max"), F.min("_f").alias("_min"))
    order = Window.partitionBy(*keys).orderBy("_slice")
    carried = slices.join(ends, [*keys, "_slice"], "left").select(
        *keys, "_slice",
        F.last("_max", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"),
        F.first("_min", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_ahead"),
    )
    rows = rows.where("_l is not null").join(carried, [*keys, "_slice"], "left")
    before, behind = F.coalesce("_before", "_carry"), F.coalesce("_behind", "_ahead")
    nearer = F.when(before.isNull() | (behind["t"] - F.col("_t") < F.col("_t") - before["t"]), F.coalesce(behind, before)).otherwise(before)
    match = {"backward": before, "forward": behind, "nearest": nearer}[direction]
    out = rows.select("_l", "_t", match.alias("_m"))
    if tolerance is not None:
        out = out.withColumn("_m", F.when(F.abs(F.col("_m")["t"] - F.col("_t")) <= tolerance, F.col("_m")))
    out = out.select("_l", "_m").unionByName(asks.where(~known).select("_l", F.lit(None).cast(kind).alias("_m")))
    return out.select("_l.*", F.col("_m.at").alias(f"{on}_right"), *(F.col(f"_m.c{i}").alias(f"{c}_right" if c in left.columns else c) for i, c in enumerate(take)))
