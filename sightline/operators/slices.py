"""Ordered slices of groups, so that no group has to be sorted or gathered by one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a group that one slice holds, about; and slices of a group at most, beyond which they grow.
ROWS, MOST = 200_000, 1_000


def with_slices(rows: DataFrame, keys: list[str], at: Column, name: str = "_slice", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with the number of their slice, and the slices of the groups that have several: keys, name.

    at: a number that orders the rows.  Groups of at most `limit` rows are slice 0;
    larger ones are cut at quantiles of `at`, so slices ascend with it and rows
    with equal `at` share a slice.  The cuts are found first and then compared
    with, so that a row's slice is the same whenever it is computed.
    """
    limit = limit or ROWS
    pos = at.cast("double")
    large = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    shares = F.lit([i / MOST for i in range(1, MOST)])
    if large.isEmpty():  # the usual case needs no cuts
        return rows.withColumn(name, F.lit(0)), large.select(*keys, F.lit(0).alias(name))
    # Only rows of large groups get here; a group's sketch has a fixed size.
    cuts = rows.withColumn("_pos", pos).join(large, keys).groupBy(*keys).agg(F.percentile_approx("_pos", shares, F.lit(10 * MOST)).alias("_q"), F.max("_n").alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.lit(limit) * MOST / F.col("_n"))).cast("int")
    cuts = cuts.select(*keys, F.array_sort(F.array_distinct(F.filter("_q", lambda x, i: (i + 1) % step == 0))).alias("_cuts"))
    # Cuts below a position are those that come before it in order.
    number = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_pos"))), F.lit(0))
    out = rows.withColumn("_pos", pos).join(cuts, keys, "left").withColumn(name, F.when(F.col("_cuts").isNull(), 0).otherwise(number)).drop("_pos", "_cuts")
    return out, cuts.select(*keys, F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias(name))
