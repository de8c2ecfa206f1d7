"""Audit of how far the sources of a language differ in their use of terms.

A term is a run of letters (A-Z in lower case, and all beyond ASCII).  A language
keeps the terms that at least `least` of its documents have.  Each group (language
and source) and each language gives a kept term the smoothed share
p = 1 + floor(SCALE * (count + smooth) / (N + smooth * V)), N being its count of
all kept terms and V their number.

Two groups of a language are compared by the sum of |p - q| over all kept terms.
p depends on the term's count alone, so a pair of groups needs only its joint
histogram of (count, count): how many terms have each combination.  Tasks tally
the combinations of terms that both groups have, over whole terms that they hold
by a deal on (language, term), and send tallies, never a pair of counts a term.
The cells with a zero follow from the groups' own histograms by subtraction.  The
difference is then worked out once a combination and multiplied.

Nulls count as empty strings, so there are groups with an empty name.  A group
without terms takes part with zero counts.  Repeated rows count as rows, each of
them as a document; doc_id is not read.  Very long texts are split and counted
like others.  Equal values rank by the name in UTF-8 order.  An empty table gives
an empty result; a language that keeps no term gives pairs of value 0.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize

#: What a term is made of, the parts of one in shares.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pairs of counts that one array pass holds, and tallies that a task keeps before it sends them.
PAIRS, TALLIES = 1_000_000, 1_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """Of each language, source and term: n (occurrences) and df (documents)."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    terms = F.sort_array(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0)))
    rows = rows.select("lang", "source", terms.alias("terms"))
    # Equal terms of a document stand side by side, so the first of them counts the document.
    before = F.concat(F.array(F.lit(None).cast("string")), F.col("terms"))
    marked = F.zip_with("terms", before, lambda term, last: F.struct(term.alias("term"), (~term.eqNullSafe(last)).cast("long").alias("first")))
    rows = rows.select("lang", "source", F.inline(marked)).where("term is not null")
    return rows.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.sum("first").alias("df"))


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """lang, term, source, n and total (n of the whole language) of the terms that a language keeps."""
    of_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).select("lang", "source", "term", "n", F.sum("df").over(of_term).alias("df"), F.sum("n").over(of_term).alias("total"))
    return counts.where(F.col("df") >= least).select("lang", "term", "source", "n", "total")


def share(count: Column, sum_: Column, kept: Column, smooth: int) -> Column:
    """The smoothed share p, in decimals as wide as needed."""
    top = F.lit(SCALE).cast("decimal(12,0)") * (count + smooth).cast("decimal(24,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, F.greatest(sum_ + kept * smooth, F.lit(1).cast("long")).cast("decimal(24,0)"))


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows ordered by language, term and source: how many terms give each two sources each combination of counts."""
    by = ["lang", "a", "b", "x", "y"]
    held: list[pd.DataFrame] = []
    size = 0

    def pairs(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        start = np.flatnonzero(((rows["lang"] != rows["lang"].shift()) | (rows["term"] != rows["term"].shift())).to_numpy())
        last = np.repeat(np.append(start[1:], len(rows)), np.diff(np.append(start, len(rows))))
        after = last - np.arange(len(rows)) - 1
        code, names = pd.factorize(rows["source"])
        kind, langs = pd.factorize(rows["lang"])
        n, upto, at = rows["n"].to_numpy(), np.cumsum(after), 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
            left = np.repeat(np.arange(at, to), after[at:to])
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after[at:to]) - after[at:to], after[at:to])
            got = pd.DataFrame({"lang": kind[left], "a": code[left], "b": code[right], "x": n[left], "y": n[right]}).groupby(by, sort=False).size().reset_index(name="m")
            yield got.assign(lang=langs[got["lang"]], a=names[got["a"]], b=names[got["b"]])
            at = to

    def blocks() -> Iterator[pd.DataFrame]:
        """Whole terms only: the last term of a batch waits for the next batch."""
        rest = None
        for b in batches:
            rows = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if len(rows):
                same = ((rows["lang"] == rows["lang"].iloc[-1]) & (rows["term"] == rows["term"].iloc[-1])).to_numpy()
                rest = rows[same]
                yield rows[~same].reset_index(drop=True)
        if rest is not None:
            yield rest.reset_index(drop=True)

    for block in blocks():
        for part in pairs(block):
            held.append(part)
            size += len(part)
        if size > TALLIES:
            held = [pd.concat(held).groupby(by, sort=False)["m"].sum().reset_index()]
            size = len(held[0])
            if size > TALLIES // 2:
                yield held[0]
                held, size = [], 0
    if held:
        yield pd.concat(held).groupby(by, sort=False)["m"].sum().reset_index()


def pair_differences(groups: DataFrame, kept: DataFrame, smooth: int) -> DataFrame:
    """lang, source, item (another source of the language) and value, for each two groups both ways.

    groups: lang, source, sum (of its counts) and v (terms that the language keeps).
    """
    dealt = kept.select("lang", "term", "source", "n").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    joint = materialize(dealt.mapInPandas(lean(_tally), "lang string, a string, b string, x long, y long, m long").groupBy("lang", "a", "b", "x", "y").agg(F.sum("m").alias("m")), "joint")
    own = kept.groupBy("lang", "source", F.col("n").alias("c")).agg(F.count("*").alias("m"))
    two = groups.select("lang", F.col("source").alias("a"), F.col("sum").alias("sum_a"), "v").join(groups.select("lang", F.col("source").alias("b"), F.col("sum").alias("sum_b")), "lang").where("a < b")
    zero = F.lit(0).cast("long")
    cell = lambda x, y, m: F.struct(x.alias("x"), y.alias("y"), m.alias("m"))
    x, y, m = F.col("x"), F.col("y"), F.col("m")
    both = joint.select("lang", "a", "b", F.inline(F.array(cell(x, y, m), cell(x, zero, -m), cell(zero, y, -m), cell(zero, zero, m))))
    alone = F.inline(F.array(cell(F.col("c"), zero, m), cell(zero, zero, -m)))
    left = two.select("lang", "a", "b").join(own.withColumnRenamed("source", "a"), ["lang", "a"]).select("lang", "a", "b", alone)
    right = two.select("lang", "a", "b").join(own.withColumnRenamed("source", "b"), ["lang", "b"]).select("lang", "a", "b", F.inline(F.array(cell(zero, F.col("c"), m), cell(zero, zero, -m))))
    none = two.select("lang", "a", "b", zero.alias("x"), zero.alias("y"), F.col("v").alias("m"))
    cells = both.unionByName(left).unionByName(right).unionByName(none).groupBy("lang", "a", "b", "x", "y").agg(F.sum("m").alias("m")).where("m <> 0")
    f = F.abs(share(F.col("x"), F.col("sum_a"), F.col("v"), smooth) - share(F.col("y"), F.col("sum_b"), F.col("v"), smooth))
    value = cells.join(two, ["lang", "a", "b"]).groupBy("lang", "a", "b").agg(F.sum(f * F.col("m")).alias("value"))
    ways = two.select("lang", "a", "b").join(value, ["lang", "a", "b"], "left").select("lang", F.coalesce("value", zero).alias("value"), "a", "b")
    one = lambda s, t: F.struct(F.col(s).alias("source"), F.col(t).alias("item"))
    return ways.select("lang", F.inline(F.array(one("a", "b"), one("b", "a"))), "value")


def audit(docs: DataFrame, least: int = 30, smooth: int = 5, top: int = 50) -> DataFrame:
    """lang, source, part, item, value and rank.

    Part `pair` has every other source of the language with the summed difference;
    part `term` the `top` terms that the group uses more than its language.
    """
    kept = materialize(kept_terms(docs, least), "kept")
    names = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    langs = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("all"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("sum"))
    groups = names.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("sum", "v", "all")))
    groups = materialize(groups, "groups")
    pair = pair_differences(groups, kept, smooth).withColumn("part", F.lit("pair"))
    p, q = share(F.col("n"), F.col("sum"), F.col("v"), smooth), share(F.col("total"), F.col("all"), F.col("v"), smooth)
    term = kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0").withColumn("part", F.lit("term"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = [(pair, None), (term, top)]
    out = [d.withColumn("rank", F.row_number().over(order)).where(F.lit(True) if n is None else F.col("rank") <= n) for d, n in ranked]
    return out[0].unionByName(out[1]).select("lang", "source", "part", "item", "value", "rank")
