"""Periodic runs of words, by refining classes of positions that begin equal factors.

Two word positions of a document are in one class at length l if the l words from
there on are equal.  Classes of length 1 are refined to length 2, 3, ...: a class
is split by which class its positions' right neighbours are in, and only classes
that are not the largest part of what they were split from need be looked at
again (the smaller half), so a document of n words takes O(n log n) moves
however periodic it is.  Each class is a list linked in the order of positions.
Members that stand next to each other in their class of length l at distance l
begin a square with period l, and that period is its smallest, since a shorter one
would put another member in between.  Squares of one period that begin side by side
are one run.

Wanted are runs that repeat their period at least `times` times.  Every position
that begins a square of such a run has times - 2 more occurrences of its factor
after it or before it, so classes of fewer than times - 1 positions are given up,
and with them, a word a length, the positions to their left; nothing is lost.
The documents of a helping are refined side by side, in array passes.

A null or empty text has no words and no runs.  A text of one word repeated is one
run of period 1.  Repeated rows get equal results, each its own row; rows with a
null doc_id likewise.  A very long text is one document like any other, held by
one task (some 80 bytes a word).  An empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, lean
from .shingles import helpings

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
#: Fixed value: what a word is made of.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are refined side by side.
HELPING = 4 << 20
#: Positions that are given up one by one.
FEW = 64
#: New pairs that wait before they are sorted among the others.
WAITING = 4096


class Pairs:
    """Neighbours at a distance that is still to come: sorted by distance, but for those that wait."""

    def __init__(self):
        self.at, self.far = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new, self.size = np.zeros((2, WAITING), np.int64), 0

    def add(self, at: np.ndarray, far: np.ndarray) -> None:
        if self.size + len(at) > WAITING:
            at, far = (np.concatenate(x) for x in ((self.at, self.new[0, : self.size], at), (self.far, self.new[1, : self.size], far)))
            turn = np.argsort(far, kind="stable")
            self.at, self.far, self.size = at[turn], far[turn], 0
        else:
            upto = self.size + len(at)
            self.new[0, self.size : upto], self.new[1, self.size : upto] = at, far
            self.size = upto

    def take(self, distance: int) -> np.ndarray:
        """Left ends of the pairs at this distance, which is never less than at the last call."""
        upto = int(np.searchsorted(self.far, distance, side="right"))
        found = self.at[:upto][self.far[:upto] == distance]
        self.at, self.far = self.at[upto:], self.far[upto:]
        if self.size:
            found = np.append(found, self.new[0, : self.size][self.new[1, : self.size] == distance])
        return found


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for `size` numbers, for each start."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


class Refinement:
    """Classes of positions that begin equal factors, of all documents of a helping at once.

    word: numbers from 0 of the words, different in different documents; every
    document is followed by one that occurs nowhere else.  most: the longest
    period wanted at each position.  least: a class of fewer is given up.
    """

    def __init__(self, word: np.ndarray, most: np.ndarray, least: int):
        self.most, self.least, self.level = most, least, 1
        n = len(word)
        self.nxt, self.prv = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.pairs = Pairs()
        self.cls = word.astype(np.int64)
        self.cls[np.bincount(word)[word] < least] = -1
        self._renumber()
        self.small, self.dead = np.flatnonzero(self.cls >= 0), np.flatnonzero(self.cls < 0)
        self._link(self.order[: self.used])

    def _renumber(self) -> None:
        """Numbers the classes from 0 and writes each one's positions side by side, with room for as many again."""
        live = np.flatnonzero(self.cls >= 0)
        at = live[np.argsort(self.cls[live], kind="stable")]
        head = np.append(True, self.cls[at[1:]] != self.cls[at[:-1]])[: len(at)]
        first = np.flatnonzero(head)
        self.cls[at] = np.cumsum(head) - 1
        self.number, self.used = len(first), len(at)
        room = 2 * len(at) + 64
        self.order, self.begin, self.size, self.count = (np.zeros(room, np.int64) for _ in range(4))
        self.order[: len(at)] = at
        self.begin[: len(first)] = first
        # size: places that a class has in `order`, some of them left; count: its members.
        self.size[: len(first)] = self.count[: len(first)] = np.diff(np.append(first, len(at)))

    def _link(self, at: np.ndarray) -> None:
        """Link the members of classes, which stand side by side in ascending order."""
        same = self.cls[at[1:]] == self.cls[at[:-1]]
        left, right = at[:-1][same], at[1:][same]
        self.nxt[left], self.prv[right] = right, left
        self._wait(left, right)

    def _unlink(self, at: np.ndarray) -> None:
        """Take members out of their lists; what comes before a stretch of them is linked to what comes behind."""
        at = at[np.lexsort((at, self.cls[at]))]
        on = np.append(self.nxt[at[:-1]] == at[1:], False)
        left, right = self.prv[at[np.append(True, ~on[:-1])]], self.nxt[at[~on]]
        self.nxt[at] = self.prv[at] = -1
        self.nxt[left[left >= 0]] = right[left >= 0]
        self.prv[right[right >= 0]] = left[right >= 0]
        both = (left >= 0) & (right >= 0)
        self._wait(left[both], right[both])

    def _wait(self, left: np.ndarray, right: np.ndarray) -> None:
        far = right - left
        keep = (far >= self.level) & (far <= self.most[left])
        self.pairs.add(left[keep], far[keep])

    def _members(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of classes and their class; the classes' places are closed up."""
        places = _ranges(self.begin[classes], self.size[classes])
        of, at = np.repeat(classes, self.size[classes]), self.order[places]
        live = self.cls[at] == of
        of, at = of[live], at[live]
        self.size[classes] = self.count[classes]
        self.order[_ranges(self.begin[classes], self.size[classes])] = at
        return at, of

    def squares(self) -> np.ndarray:
        """Where squares begin whose period is the present length."""
        at = self.pairs.take(self.level)
        return np.unique(at[self.nxt[at] == at + self.level]) if len(at) else at

    def _drop(self, at: int) -> list[int]:
        """Give up one position, and the rest of its class if it is too small then; all that were given up."""
        of = self.cls[at]
        if of < 0:
            return []
        left, right = int(self.prv[at]), int(self.nxt[at])
        self.cls[at] = self.prv[at] = self.nxt[at] = -1
        self.count[of] -= 1
        if left >= 0:
            self.nxt[left] = right
        if right >= 0:
            self.prv[right] = left
        if left >= 0 and right >= 0 and self.level <= right - left <= self.most[left]:
            self.pairs.add(np.array([left]), np.array([right - left]))
        if self.count[of] < self.least and (left >= 0 or right >= 0):
            return [at, *self._drop(max(left, right))]
        if 2 * self.count[of] < self.size[of]:
            self._members(np.array([of]))
        return [at]

    def refine(self) -> bool:
        """From this length to the next; whether anything can still be found."""
        gone, i = self.dead - 1, self.small - 1
        gone, i = gone[gone >= 0], i[i >= 0]
        gone, i = gone[self.cls[gone] >= 0], i[(self.cls[i] >= 0) & (self.most[i] > self.level)]
        self.level += 1
        self.small = self.dead = np.zeros(0, np.int64)
        if not len(i) and not len(gone):
            return False
        if not len(i) and len(gone) <= FEW:
            self.dead = np.array([x for at in gone.tolist() for x in self._drop(at)], np.int64)
            return True
        if self.used + len(i) > len(self.order) or self.number + len(i) > len(self.count):
            self._renumber()
        # Parts: members of a class whose right neighbours are in one small class.
        i = np.sort(i)
        key = self.cls[i] * self.number + self.cls[i + 1]
        turn = np.argsort(key, kind="stable")
        i, key = i[turn], key[turn]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        amount = np.diff(np.append(first, len(i)))
        parent = self.cls[i[first]]
        split = amount < self.count[parent]  # else the whole class goes on as it is
        i, parent, amount = i[np.repeat(split, amount)], parent[split], amount[split]
        moved = np.concatenate([i, gone])
        if not len(moved):
            return True
        lost, of = np.unique(np.concatenate([parent, self.cls[gone]]), return_inverse=True)
        self.count[lost] -= np.bincount(of, np.concatenate([amount, np.ones(len(gone))]), len(lost)).astype(np.int64)
        self._unlink(moved)
        # The largest part of a class is not looked at again: what stays, or else one of its new parts.
        stays, best = self.count[lost], np.zeros(len(lost), np.int64)
        of = of[: len(parent)]
        np.maximum.at(best, of, amount)
        largest = np.flatnonzero((amount == best[of]) & (best > stays)[of])
        largest = largest[np.unique(of[largest], return_index=True)[1]]
        again = np.ones(len(amount), bool)
        again[largest] = False
        # New parts get numbers and places; those of too few members are given up.
        enough = amount >= self.least
        within = np.repeat(enough, amount)
        new = np.where(enough, self.number + np.cumsum(enough) - 1, -1)
        self.cls[i], self.cls[gone] = np.repeat(new, amount), -1
        kept, size = i[within], amount[enough]
        fresh = slice(self.number, self.number + len(size))
        self.order[self.used : self.used + len(kept)] = kept
        self.begin[fresh] = self.used + np.cumsum(size) - size
        self.size[fresh] = self.count[fresh] = size
        self.number, self.used = fresh.stop, self.used + len(kept)
        self._link(kept)
        # What stays, where it is the smaller part, or too few, or leaves more places empty than it fills.
        few, turned = (stays > 0) & (stays < self.least), (stays >= self.least) & (best > stays)
        at, of = self._members(lost[few | turned | (2 * stays < self.size[lost])])
        out = at[np.isin(of, lost[few])]
        self.cls[out] = self.nxt[out] = self.prv[out] = -1
        self.count[lost[few]] = 0
        self.small = np.concatenate([i[np.repeat(again & enough, amount)], at[np.isin(of, lost[turned])]])
        self.dead = np.concatenate([gone, i[~within], out])
        return True


def runs_of(texts: list[list], times: int, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of lists of words: number of the list, start, length and period, ordered by list, start and period."""
    words = np.fromiter(map(len, texts), np.int64, len(texts))
    number = count()
    known: defaultdict = defaultdict(number.__next__)
    parts = []
    for t in texts:
        parts += [np.fromiter(map(known.__getitem__, t), np.int64, len(t)), np.array([next(number)])]
        known.clear()
    begin = np.cumsum(words + 1) - words - 1
    refinement = Refinement(np.concatenate(parts), np.repeat(words // times, words + 1), times - 1)
    start, length, period = [], [], []
    while True:
        if len(at := refinement.squares()):
            q = refinement.level
            first = np.flatnonzero(np.append(True, np.diff(at) != 1))
            size = np.diff(np.append(first, len(at))) - 1 + 2 * q
            whole = size >= max(shortest, times * q)
            start.append(at[first][whole])
            length.append(size[whole])
            period.append(np.full(int(whole.sum()), q))
        if not refinement.refine():
            break
    if not start:
        return (np.zeros(0, np.int64),) * 4
    start, length, period = map(np.concatenate, (start, length, period))
    turn = np.lexsort((period, start))
    start, length, period = start[turn], length[turn], period[turn]
    text = np.searchsorted(begin, start, side="right") - 1
    return text, start - begin[text], length, period


def find_runs(docs: DataFrame, times: int = 4, shortest: int = 6) -> DataFrame:
    """doc_id, n_words, runs (all, by start and period) and collapsed.

    A run is a stretch of words as long as it goes with one smallest period, of
    `times` periods and `shortest` words at least.  collapsed: the words joined by
    a space, without those that a run has beyond its first period.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            for lo, hi in helpings(texts, HELPING):
                yield some(b["doc_id"].iloc[lo:hi], [t.encode().split() for t in texts[lo:hi]])

    def some(ids: pd.Series, words: list[list]) -> pd.DataFrame:
        text, start, length, period = runs_of(words, times, shortest)
        upto = np.searchsorted(text, np.arange(len(words) + 1)).tolist()
        found = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
        runs, left = [], []
        for k, w in enumerate(words):
            of = found[upto[k] : upto[k + 1]]
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in of])
            if of:
                keep = np.ones(len(w), bool)
                for s, n, q in of:
                    keep[s + q : s + n] = False
                w = list(compress(w, keep))
            left.append(b" ".join(w).decode())
        return pd.DataFrame({"doc_id": ids.to_numpy(), "n_words": [len(w) for w in words], "runs": runs, "collapsed": left})

    return documents(docs).mapInPandas(lean(run), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def summarise(found: DataFrame) -> DataFrame:
    """One row per document: n_runs, the longest run, and digests of all runs and of what is left."""
    best = F.expr("aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (a, r) -> if(a is null or r.length > a.length, r, a))")
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * best.length div best.period")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document (by crc32 of its id) goes on periodically from some word on.

    With h that checksum, g = h div 10 and n the number of words (n > 0), word
    i >= a becomes word a + (i - a) mod p, where a = g mod n and
    p = 1 + (n - a) div (3 + g mod 8).  A null doc_id counts as an empty string.
    """
    rows = documents(docs).withColumn("h", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    words = F.when(F.expr("h % 10 = 0"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.select("doc_id", "text", words.alias("words"), F.expr("h div 10").alias("g")).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.expr("case when n > 0 then g % n end")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    changed = F.expr("array_join(transform(sequence(0L, n - 1L), i -> words[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return rows.select("doc_id", F.when(F.col("p").isNotNull(), changed).otherwise(F.col("text")).alias("text"))
