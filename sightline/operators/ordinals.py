"""Places of rows in a global order, without sorting or counting them in one task.

Ranges of the order are found from a hash sample of bounded size; counts of ranges,
not rows, come to the driver.  A page is looked up by narrowing a range until it is
small: each pass counts the rows between cuts and keeps the range that the page lies
in, as a condition on the order columns that reaches the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that are sorted at last, ranges that a pass counts, and rows of a sample.
SMALL, RANGES, SAMPLE = 100_000, 64, 4_096


def _equal(name: str, value) -> Column:
    return F.col(name).isNull() if value is None else F.col(name) == F.lit(value)


def _above(name: str, value) -> Column:
    """At or above a cut; nulls come first, NaN last."""
    return F.col(name).isNotNull() if value is None else F.col(name) >= F.lit(value)


def _cuts(rows: DataFrame, name: str, n: int) -> list:
    """Values of a column that split its rows into ranges of about equal size: at most RANGES, ascending, no nulls."""
    share = min(1.0, 2.0 * SAMPLE / n)
    limit = min(2**63 - 1, int(-(2**63) + 2**64 * share))
    value = F.col(name)
    if dict(rows.dtypes)[name] in ("double", "float"):
        rows = rows.where(~F.isnan(name))
    # By the hash of all columns, so that many rows of one value are drawn as often as they are there.
    drawn = rows.where(value.isNotNull()).where(F.xxhash64(*rows.columns) <= limit).select(value.alias("v")).limit(8 * SAMPLE).collect()
    values = sorted(r["v"] for r in drawn)
    return sorted({values[len(values) * i // RANGES] for i in range(1, RANGES)}) if values else []


def _narrow(rows: DataFrame, order: list[str], skip: int, size: int, n: int, small: int) -> tuple[list[DataFrame], int]:
    """Parts of rows, in order, that hold the rows from `skip` on, `size` of them; and how many of theirs come before."""
    if n <= small or not order:
        return [rows], skip
    name, rest = order[0], order[1:]
    cuts = _cuts(rows, name, n)
    edges = [_above(name, c) for c in [None, *cuts]]
    # Rows at or above each cut: one pass with partial sums, a row of numbers to the driver.
    sums = rows.agg(*(F.count_if(e).alias(f"c{i}") for i, e in enumerate(edges))).first()
    upto = [0, *(n - sums[i] for i in range(len(edges))), n]  # nulls, then a range for each edge
    parts, before = [], None
    for i in range(len(upto) - 1):
        lo, hi = upto[i], upto[i + 1]
        if hi <= skip or lo >= skip + size or lo == hi:
            continue
        part = rows.where(F.col(name).isNull()) if i == 0 else rows.where(edges[i - 1] & (F.col(name) < F.lit(cuts[i - 1]))) if i < len(edges) else rows.where(edges[-1])
        own, wanted = max(0, skip - lo), min(hi, skip + size) - max(lo, skip)
        if i == 0:
            got, first = _narrow(part, rest, own, wanted, hi - lo, small)
        elif hi - lo == n > small:  # the cuts do not split it: one value has nearly all
            got, first = _by_value(part, order, own, wanted, n, small)
        else:
            got, first = _narrow(part, order, own, wanted, hi - lo, small)
        before = first if before is None else before
        parts += got
    return parts, before or 0


def _by_value(rows: DataFrame, order: list[str], skip: int, size: int, n: int, small: int) -> tuple[list[DataFrame], int]:
    """The same where no cut splits the rows: those below the least cut value, with it, and above it."""
    name = order[0]
    value = _cuts(rows, name, n)[:1] or [rows.agg(F.min(name)).first()[0]]
    equal = _equal(name, value[0])
    below = F.coalesce(F.col(name) < F.lit(value[0]), F.lit(True))
    c = rows.agg(F.count_if(below).alias("b"), F.count_if(equal).alias("e")).first()
    parts, before, lo = [], None, 0
    for cond, count, cols in ((below, c["b"], order), (equal, c["e"], order[1:]), (~below & ~equal, n - c["b"] - c["e"], order)):
        hi = lo + count
        if hi > skip and lo < skip + size and count:
            got, first = _narrow(rows.where(cond), cols, max(0, skip - lo), min(hi, skip + size) - max(lo, skip), count, small)
            before = first if before is None else before
            parts += got
        lo = hi
    return parts, before or 0


def rows_at(rows: DataFrame, order: list[str], skip: int, size: int, small: int | None = None, n: int | None = None) -> DataFrame:
    """Rows number `skip` (from 0) to skip + size of rows in the order of columns, nulls first.

    The columns should tell rows apart; of rows that are equal in all of them,
    which one has which number is open.
    """
    n = rows.count() if n is None else n
    parts, before = _narrow(rows, order, skip, size, n, small or SMALL)
    if not parts:
        return rows.limit(0)
    return reduce(DataFrame.unionAll, parts).orderBy(*order).offset(before).limit(size)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their number from 0 in the order of columns.

    Ranges are dealt once and kept (in the shared folder where there is one), so
    that what is counted and what is numbered are the same partitions.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id())
    dealt = dealt.checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else dealt.persist()
    part, place = F.shiftright("_i", 33), F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    counts = dealt.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    before = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row per partition
    return dealt.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + place).drop("_i", "_p", "_b")
