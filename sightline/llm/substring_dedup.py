"""Fuzzy repeated passages by collinear chaining.

Equal texts are one text first: a copy repeats its representative, the one with
the smallest doc_id, from its first word to its last.

Seeds are four-word shingles, half of them by their hash: ten edits in fifty
words leave at least seven four-word shingles whole, mostly many more.  A seed
that up to HOLDERS documents have joins each of them to all earlier ones; a more
frequent one joins each to the first.  Tasks do that for frequent seeds before the
shuffle, and pass on their first holder alone.

A passage may be put together of frequent ones whose first holders have other parts
of it.  So frequent seeds are matched once more in pairs, with seeds further on in
the text: who has the pair has both parts, and each is joined to the first one that
has them.  One match of a pair is enough to compare the texts.

Matches of two documents that lie on neighbouring diagonals and spread far enough
make a region.  The stretches of both texts around it are brought together and
all their common four-word shingles are chained in order: a Fenwick tree over the
earlier text's positions holds the best chain that ends before each, with a cost
for what is skipped.  Chains are aligned word by word, and stretches with at least
`words` words of which `similarity` agree are reported.  A region whose matches
all lie in passages found before, with another document, is passed over.

Result: rows of passages of a document that an earlier one has too (several of
them if several have it): doc_id, start and stop (bytes of the text, at edges of
words), n_words, n_equal, owner_id, owner_start, owner_stop.  The owner's own
passage stays.

Nulls, empty texts and texts of fewer than four words have no seeds.  Rows with
a null doc_id take no part.  Equal rows under one doc_id are one document;
different texts under one doc_id are looked through (and cut) each by itself.
Very long texts are read whole; only the stretches around matches are compared.
Of passages that several documents have, each but the first is reported; of
equally good chains the one that begins first in the text is taken first.  An
empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, forest, fresh, lean, mark_maybe, materialize, tasks
from .shingles import helpings, shingle_hashes, word_hashes

SIZE = 4
#: Of how many seeds one is taken.
TAKEN = 2
#: Frequent seeds are matched again in pairs: with one so many words behind, from each of these ranges.
AHEAD = [(8, 18), (18, 28), (28, 38), (38, 48)]
#: What a match of pairs counts for: it is a region by itself.
SURE = 1 << 20
#: Bits of a seed's hash that tasks agree on, and 64-bit words of the map of frequent seeds at most.
LOW, MAP_WORDS = (1 << 48) - 1, 1 << 20
#: A seed joins all pairs of up to HOLDERS documents; beyond, each to the first.  A pair of seeds joins each to the first.
HOLDERS, OF_PAIRS = 16, 1
#: Seeds that a task holds at a time.
FLUSH = 400_000
#: Words of a block as a power of two; a region needs LEAST matches, of which two begin SPREAD words apart.
BLOCK, LEAST, SPREAD = 4, 2, 9
#: Matches in a row of which one is kept for the chain.
THIN = 24
#: Bytes read on either side of a region, the cost of a skipped byte against a seed's weight of 30, and the bytes that a word counts for.
MARGIN, GAP, WORD = 1024, 0.1, 6
#: Cells of a gap between anchors that is aligned in one table.
CELLS = 1 << 22
SPANS = "doc_id long, start int, stop int, n_words int, n_equal int, owner_id long, owner_start int, owner_stop int"


def occurrence(h: np.ndarray) -> np.ndarray:
    """For each hash, how often it stands before its place."""
    order = np.argsort(h, kind="stable")
    first = np.searchsorted(h[order], h[order], side="left")
    out = np.empty(len(h), np.int64)
    out[order] = np.arange(len(h)) - first
    return out


def _planes(x: np.ndarray) -> bytes:
    """First bytes of all values, then their second bytes, and so on."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def pack(h: np.ndarray, which: np.ndarray, place: np.ndarray, ids: np.ndarray) -> bytes:
    """Seeds in order of text and place as planes of bytes: 6 bytes of the hash, and what texts' keys and places grow by.

    ids: a row of keys for each text, which: the text of each seed.
    """
    first = np.append(True, which[1:] != which[:-1])
    begun = np.flatnonzero(first)
    ids = ids[which[begun]]
    parts = [np.array([len(h), len(begun), ids.shape[1]], np.int64).tobytes(), _planes(np.diff(np.append(begun, len(h))))]
    parts += [_planes(np.diff(ids[:, k], prepend=0)) for k in range(ids.shape[1])]
    parts += [_planes(np.where(first, c, np.diff(c, prepend=0)).astype(np.uint32)) for c in (place >> 32, place & 0xFFFFFFFF)]
    return b"".join([*parts, h.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()])


def unpack(blob: bytes, bucket: int) -> list[np.ndarray]:
    """[h, keys, place] of packed seeds; h is the 6 bytes with the bucket above them."""
    n, texts, keys = np.frombuffer(blob, np.int64, 3).tolist()
    at = 24

    def planes(rows: int, kind) -> np.ndarray:
        nonlocal at
        width = np.dtype(kind).itemsize
        x = np.frombuffer(blob, np.uint8, rows * width, at).reshape(width, rows)
        at += rows * width
        return np.ascontiguousarray(x.T).view(kind).ravel().astype(np.int64)

    count = planes(texts, np.int64)
    ids = [np.repeat(np.cumsum(planes(texts, np.int64)), count) for _ in range(keys)]
    begun = np.append(0, np.cumsum(count))[:-1]
    word, byte = (np.append(0, np.cumsum(planes(n, np.uint32))) for _ in range(2))
    word, byte = (c[1:] - np.repeat(c[begun], count) for c in (word, byte))
    h = np.zeros((n, 8), np.uint8)
    h[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, at).reshape(n, 6)
    return [h.view(np.int64).ravel() + (bucket << 48), *ids, (word << 32) + byte]


def nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Texts (node, text) in the order of doc_id; where a doc_id has several rows, also what each node is (node, doc_id, v: a hash of the text)."""
    rows = documents(docs).where("doc_id is not null")
    if not _repeats(docs):
        return rows.withColumnRenamed("doc_id", "node"), None
    rows = rows.withColumn("v", F.md5("text")).dropDuplicates(["doc_id", "v"])
    rows = rows.repartitionByRange(tasks(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "v").withColumn("node", F.monotonically_increasing_id())
    rows = materialize(rows, "texts")
    return rows.select("node", "text"), rows.select("node", "doc_id", "v")


def copies(rows: DataFrame) -> DataFrame:
    """(node, rep) of each text that an earlier node, the first of all, has as well."""
    keys = rows.select("node", F.unhex(F.md5("text")).alias("k"))
    first = materialize(keys.groupBy("k").agg(F.min("node").alias("rep"), F.count("*").alias("n")).where("n > 1").select("k", "rep"), "first")
    return materialize(keys.join(first, "k").where("node <> rep").select("node", "rep"), "copies")


def _seeds_of(texts: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, node, place) of the seeds of texts, by node and place; place is the word's number times 2**32 plus its first byte."""
    hashes, first, _, words = word_hashes(texts)
    which = np.repeat(np.arange(len(texts)), words)
    base = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    spot = ((np.arange(len(which)) - (np.cumsum(words) - words)[which]) << 32) + first - base[which]
    h = shingle_hashes(hashes, SIZE)
    take = np.flatnonzero((which[: len(h)] == which[SIZE - 1 :]) & ((h >> np.uint64(13)) % np.uint64(TAKEN) == 0)) if len(h) else np.zeros(0, np.int64)
    h, which, spot = h[take], which[take], spot[take]
    order = np.lexsort((spot, ids[which])) if len(texts) > 1 else slice(None)
    return h[order], ids[which][order], spot[order]


def least_within(value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least value of each range [lo, hi), which is not empty, by ranges of lengths that are powers of two."""
    out = np.empty(len(lo), value.dtype)
    level = np.frexp(hi - lo)[1] - 1
    table = value
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k)])
        step = 1 << k
        table = np.minimum(table[:-step], table[step:]) if len(table) > step else table
    return out


def in_pairs(h: np.ndarray, node: np.ndarray, place: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of frequent seeds (in order of node and place) as seeds, at the first one's place.

    The other is that with the least code of those in a range of words ahead, so
    two texts that have the same passage mostly pair the same seeds, and texts that
    have only parts of it in other surroundings do not.
    """
    low = h & np.uint64(LOW)
    bit = low % np.uint64(64 * len(frequent))
    some = np.flatnonzero((frequent[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))
    h, node, place = low[some], node[some], place[some]
    if not len(h):
        return h, node, place
    code = h * np.uint64(0xD6E8FEB86659FD93)
    code ^= code >> np.uint64(32)
    number = np.cumsum(np.append(False, node[1:] != node[:-1]))
    at = (number << 33) + (place >> 32)
    out = []
    for k, (near, far) in enumerate(AHEAD):
        lo, hi = np.searchsorted(at, at + near), np.searchsorted(at, at + far)
        has = np.flatnonzero(hi > lo)
        both = (h[has] * np.uint64(0x9E3779B97F4A7C15 + 2 * k)) ^ least_within(code, lo[has], hi[has])
        both *= np.uint64(0xBF58476D1CE4E5B9)
        out.append((both ^ (both >> np.uint64(29)), node[has], place[has]))
    h, node, place = map(np.concatenate, zip(*out, strict=True))
    order = np.lexsort((place, node))
    return h[order], node[order], place[order]


def by_seed(h: np.ndarray, node: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of node and place brought into order of seed, and where they stood.

    A shingle that a text has had before is a seed twice: as what it is, and
    under a code with its number, so that runs of one word meet in order.
    """
    order = np.argsort(h, kind="stable")
    h, node, place = h[order], node[order], place[order]
    same = np.append(False, (h[1:] == h[:-1]) & (node[1:] == node[:-1]))
    again = np.flatnonzero(same)
    if not len(again):
        return h, node, place, order
    begun = np.flatnonzero(~same)
    nth = again - begun[np.searchsorted(begun, again, side="right") - 1]
    code = (h[again] ^ nth.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    h, node, place, order = np.append(h, code), np.append(node, node[again]), np.append(place, place[again]), np.append(order, np.full(len(again), -1))
    o = np.lexsort((place, node, h))
    return h[o], node[o], place[o], order[o]


def combine(h: np.ndarray, node: np.ndarray, place: np.ndarray, last: bool, holders: int = HOLDERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the matches of seeds (in order of node and place), the places of rows to go on, and the seeds that more than `holders` documents have.

    Unless this is the last time a seed is looked at, only those are matched; of these only the first row goes on.
    """
    n = len(h)
    h, node, place, order = by_seed(h, node, place)
    begins = np.append(True, h[1:] != h[:-1])
    fresh_doc = begins | np.append(True, node[1:] != node[:-1])
    group = np.cumsum(begins) - 1
    docs = np.bincount(group[fresh_doc], minlength=int(group[-1]) + 1)
    frequent = (h[begins][docs > holders] & np.uint64(LOW)).view(np.int64)
    if last:
        take = docs > 1
        return cells(links([h[take[group]], node[take[group]], place[take[group]]], holders)), np.zeros(0, np.int64), frequent
    many = (docs > holders)[group]
    gone = order[many & ~begins]
    goes_on = np.ones(n, bool)
    goes_on[gone[gone >= 0]] = False
    return cells(links([h[many], node[many], place[many]], holders)), np.flatnonzero(goes_on), frequent


def with_frequent(met: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Cells, and rows without a node for frequent seeds: (-1, -1, seed, 0, 0)."""
    marks = np.zeros((len(frequent), 5), np.int64)
    marks[:, :2], marks[:, 2] = -1, frequent
    return np.concatenate([met, marks])


def cells(met: list[np.ndarray]) -> np.ndarray:
    """Matches (node, owner, at, own) as rows (node, owner, at, own, n), one for each pair of blocks, with its least places."""
    if not len(met[0]):
        return np.zeros((0, 5), np.int64)
    d, o, at, own = met
    key = np.zeros(len(d), np.uint64)
    for c in (d, o, at >> (32 + BLOCK), own >> (32 + BLOCK)):
        key = (key ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    order = np.lexsort((at, key))
    first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    n = np.diff(np.append(first, len(key)))
    k = order[first]
    return np.stack([d[k], o[k], at[k], np.minimum.reduceat(own[order], first), n], 1)


def seeds(rows: DataFrame, buckets: int, pairs=None) -> DataFrame:
    """Packed seeds of the texts (bucket, cells: false, data), and cells of those that many texts of a task have (cells: true).

    pairs: a broadcast map of frequent seeds, whose pairs are taken instead.
    """

    holders = HOLDERS if pairs is None else OF_PAIRS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, turn = [], 0, 0

        def flush():
            h, node, place = map(np.concatenate, zip(*held, strict=True))
            if len(held) > 1:
                order = np.argsort(node, kind="stable")
                h, node, place = h[order], node[order], place[order]
            met, on, frequent = combine(h, node, place, False, holders)
            if pairs is None:
                met = with_frequent(met, frequent)
            h, node, place = h[on], node[on], place[on]
            bucket = ((h >> np.uint64(48)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
            order = np.argsort(bucket, kind="stable")
            h, node, place = h[order], node[order], place[order]
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = []
            for k in np.flatnonzero(np.diff(cut)).tolist():
                x, y = cut[k], cut[k + 1]
                ids, which = np.unique(node[x:y], return_inverse=True)
                out.append((k, False, pack(h[x:y], which, place[x:y], ids[:, None])))
            if len(met):
                out.append((turn % buckets, True, met.tobytes()))
            return pd.DataFrame(out, columns=["bucket", "cells", "data"])

        for b in batches:
            texts, ids = b["text"].tolist(), b["node"].to_numpy(np.int64)
            for i, j in helpings(texts):
                found = _seeds_of(texts[i:j], ids[i:j])
                if pairs is not None:
                    found = in_pairs(*found, pairs.value)
                if not len(found[0]):
                    continue
                held.append(found)
                size += len(found[0])
                if size >= FLUSH:
                    yield flush()
                    held, size, turn = [], 0, turn + 1
        if held:
            turn += int(held[0][1][0]) & 0xFFFF
            yield flush()

    return rows.select("node", F.col("text").cast("binary").alias("text")).mapInPandas(lean(run), "bucket int, cells boolean, data binary")


def meet(rows: DataFrame, pairs=None) -> DataFrame:
    """Matches (node, owner, at, own, n) of documents that share seeds, one row for each pair of blocks.

    Without pairs (as in `seeds`) also rows that name the frequent seeds (with_frequent).
    """
    names = ["node", "owner", "at", "own", "n"]
    first_round = pairs is None
    holders = HOLDERS if first_round else OF_PAIRS

    def run(batches):
        import pyarrow as pa

        held, size, now = [], 0, None

        def out(rows: np.ndarray):
            if not first_round:
                rows = rows * np.array([1, 1, 1, 1, SURE])
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names)

        def all_held():
            h, node, place = map(np.concatenate, zip(*held, strict=True))
            order = np.lexsort((place, node))
            return h[order].view(np.uint64), node[order], place[order]

        def matched(rows, last: bool):
            met, on, frequent = combine(*rows, last, holders)
            return out(with_frequent(met, frequent) if first_round else met), on

        for b in batches:
            for bucket, is_cells, data in zip(b.column("bucket").to_pylist(), b.column("cells").to_pylist(), b.column("data"), strict=True):
                if is_cells:
                    yield out(np.frombuffer(data.as_py(), np.int64).reshape(-1, 5))
                    continue
                if held and bucket != now:
                    yield matched(all_held(), True)[0]
                    held, size = [], 0
                now = bucket
                held.append(unpack(data.as_py(), bucket))
                size += len(held[-1][0])
                if size > 2 * FLUSH:  # frequent seeds need not pile up
                    rows_ = all_held()
                    met, on = matched(rows_, False)
                    yield met
                    held = [tuple(c[on].view(np.int64) for c in rows_)]
                    size = size // 2 if len(on) > FLUSH else len(on)
        if held:
            yield matched(all_held(), True)[0]

    n = 4 * tasks(rows.sparkSession)  # buckets are matched as arrays: small ones
    dealt = seeds(rows, n, pairs).repartition(tasks(rows.sparkSession), "bucket").sortWithinPartitions("cells", "bucket")
    return dealt.mapInArrow(lean(run), ", ".join(f"{c} long" for c in names))


def frequent_map(met: DataFrame):
    """A broadcast map of the frequent seeds that `meet` has named, or None where there are none.

    It has 16 bits a seed and MAP_WORDS words at most; more seeds make more pairs
    than are needed, and the same results.
    """
    named = met.where("node = -1").select(F.col("at").alias("h")).distinct()
    n = named.count()
    if not n:
        return None
    words = min(MAP_WORDS, 1 << max(6, (n * 16 // 64).bit_length()))
    place = F.pmod(F.col("h"), F.lit(64 * words))
    rows = named.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {64 * words}) % 64 as int))")).alias("bits"))
    out = np.zeros(words, np.uint64)
    for r in rows.collect():  # MAP_WORDS rows at most
        out[r["w"]] = r["bits"] & (2**64 - 1)
    return met.sparkSession.sparkContext.broadcast(out)


def _differ(columns: list[np.ndarray]) -> np.ndarray:
    """Whether each row but the first differs from that before it."""
    return np.logical_or.reduce([c[1:] != c[:-1] for c in columns])


def links(rows: list[np.ndarray], holders: int = HOLDERS) -> list[np.ndarray]:
    """Matches (node, owner, at, own) of rows (h, node, place) in this order.

    Of up to `holders` documents with a seed all pairs; else each with the first.
    """
    h, node, place = rows
    if not len(h):
        return [node, node, place, place]
    fresh_doc = np.append(True, _differ(rows[:-1]))
    holder = np.flatnonzero(fresh_doc)  # a document's first occurrence of a seed
    mine = np.cumsum(fresh_doc) - 1
    begins = np.append(True, h[holder][1:] != h[holder][:-1])
    group = np.cumsum(begins) - 1
    start = np.flatnonzero(begins)
    count, rank = np.diff(np.append(start, len(holder))), np.arange(len(holder)) - start[group]
    n, r = count[group][mine], rank[mine]
    met, with_ = [], []
    for k in range(1, min(holders - 1, int(r.max(initial=0))) + 1):
        i = np.flatnonzero((r >= k) & (n <= holders))
        met.append(i)
        with_.append(holder[mine[i] - k])
    i = np.flatnonzero((n > holders) & (r > 0))
    i, o = np.concatenate([*met, i]), np.concatenate([*with_, holder[start[group[mine[i]]]]])
    return [node[i], node[o], place[i], place[o]]


def regions(rows: np.ndarray) -> np.ndarray:
    """Regions (node, owner, lo, hi, owner_lo, owner_hi) in bytes, of cells in order of node, owner and place.

    Cells belong together if they are at most four blocks apart and at most two diagonals.
    """
    d, o, at, own, n = rows.T
    block, other = at >> (32 + BLOCK), own >> (32 + BLOCK)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(1, 7):
        i = np.arange(max(0, len(d) - k))
        j = i + k
        near = (d[i] == d[j]) & (o[i] == o[j]) & (block[j] - block[i] <= 4) & (np.abs((other[j] - block[j]) - (other[i] - block[i])) <= 2)
        a.append(i[near])
        b.append(j[near])
    label = forest(np.concatenate(a), np.concatenate(b), len(d))
    order = np.argsort(label, kind="stable")
    first = np.flatnonzero(np.append(True, label[order][1:] != label[order][:-1]))
    low, high = (lambda c: np.minimum.reduceat(c[order], first)), (lambda c: np.maximum.reduceat(c[order], first))
    n = np.add.reduceat(n[order], first)
    good = (n >= LEAST) & (high(at >> 32) - low(at >> 32) >= SPREAD) | (n >= SURE)
    mask = 0xFFFFFFFF
    k = order[first]
    return np.stack([d[k], o[k], low(at) & mask, high(at) & mask, low(own & mask), high(own & mask)], 1)[good]


def matches(rows: DataFrame) -> DataFrame:
    """Regions of matches: node, owner, and bytes lo, hi, owner_lo, owner_hi of the first and last."""
    met = materialize(meet(rows), "met")
    frequent = frequent_map(met)
    met = met.where("node >= 0")
    if frequent is not None:
        met = met.unionByName(meet(rows, frequent))
    names = ["node", "owner", "lo", "hi", "owner_lo", "owner_hi"]

    def run(batches):
        import pyarrow as pa

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in regions(rows).T], names)

        held, size = [], 0
        for b in batches:
            held.append(np.stack([c.to_numpy() for c in b.columns], 1))
            size += len(held[-1])
            if size < 200_000:
                continue
            rows = np.concatenate(held)
            cut = int(np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(1))[-1]) + 1 if (rows[:, :2] != rows[-1, :2]).any() else 0
            size = 0
            if cut:
                yield out(rows[:cut])
                rows = rows[cut:]
            held = [rows]
        if held and sum(map(len, held)):
            yield out(np.concatenate(held))

    dealt = met.repartition(tasks(rows.sparkSession), "node").sortWithinPartitions("node", "owner", "at", "own")
    return dealt.mapInArrow(lean(run), ", ".join(f"{c} long" for c in names))


def chains(at: np.ndarray, own: np.ndarray, weight: float = 30.0) -> list[np.ndarray]:
    """Disjoint best chains of anchors that ascend in both texts, each as indices.

    The value of a chain is its anchors' weights less GAP for each byte between
    them, halved over the two texts; a chain that falls to nothing is not
    carried on.
    """
    order = np.lexsort((own, at))
    x, y = at[order].tolist(), own[order].tolist()
    n = len(x)
    rank = {v: k + 1 for k, v in enumerate(sorted(set(y)))}
    top = len(rank)
    best = [(-1e18, -1)] * (top + 1)  # Fenwick tree of the best value, with what lies before added back
    value, back = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and x[j] == x[i]:  # anchors at one place can't follow each other
            k, found = rank[y[j]] - 1, (-1e18, -1)
            while k > 0:
                if best[k] > found:
                    found = best[k]
                k -= k & -k
            gain = found[0] - GAP / 2 * (x[j] + y[j])
            value[j], back[j] = (weight + gain, found[1]) if gain > 0 else (weight, -1)
            j += 1
        for m in range(i, j):
            k, item = rank[y[m]], (value[m] + GAP / 2 * (x[m] + y[m]), m)
            while k <= top:
                if item > best[k]:
                    best[k] = item
                k += k & -k
        i = j
    used, out = [False] * n, []
    for e in sorted(range(n), key=lambda e: -value[e]):
        chain = []
        while e >= 0 and not used[e]:
            used[e] = True
            chain.append(e)
            e = back[e]
        if len(chain) > 1:
            out.append(order[chain[::-1]])
    return out


def thin(at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Matches to chain: of those that go on word by word in both texts the first, the last and each THIN-th."""
    on = (np.diff(at) == 1) & (np.diff(own) == 1)
    first = np.append(True, ~on)
    begun = np.flatnonzero(first)
    nth = np.arange(len(at)) - begun[np.cumsum(first) - 1]
    return np.flatnonzero((nth % THIN == 0) | np.append(~on, True))


def _common(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Places of a longest common subsequence."""
    n, m = len(x), len(y)
    best = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):
        row = np.maximum(best[i + 1, :m], np.where(x[i] == y, best[i + 1, 1:] + 1, 0))
        best[i, :m] = np.maximum.accumulate(row[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < n and j < m and best[i, j]:
        if x[i] == y[j] and best[i, j] == best[i + 1, j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(x: np.ndarray, y: np.ndarray, anchors: list[tuple[int, int]]) -> np.ndarray:
    """For each word of x the word of y it equals in an alignment through the anchors, or -1.

    Gaps hold no common seed in order.  One of more than CELLS cells is aligned
    from its two ends, each as far as CELLS allows.
    """
    to = np.full(len(x), -1, np.int64)
    i = j = 0

    def fill(a, b, c, d):
        """Words [a, b) of x against [c, d) of y."""
        if a >= b or c >= d:
            return
        if b - a == d - c:
            same = np.flatnonzero(x[a:b] == y[c:d])
            if 2 * len(same) >= b - a:
                to[a + same] = c + same
                return
        if (b - a) * (d - c) > CELLS:
            n = int(CELLS**0.5) // 2
            p, q = min(n, (b - a) // 2), min(n, (d - c) // 2)
            fill(a, a + p, c, c + q)
            fill(b - p, b, d - q, d)
            return
        for p, q in _common(x[a:b], y[c:d]):
            to[a + p] = c + q

    done = False
    for a, c in anchors:
        if a < i or c < j:  # it overlaps what is aligned
            if a >= i or a - c != i - j:
                continue
        elif done:
            fill(i, a, j, c)
        if not done:  # before the first anchor: straight back
            k = min(a, c)
            same = np.flatnonzero(x[a - k : a] == y[c - k : c])
            to[a - k + same] = c - k + same
            done = True
        n = min(SIZE, len(x) - a, len(y) - c)
        same = np.flatnonzero(x[a : a + n] == y[c : c + n])
        to[a + same] = c + same
        i, j = a + n, c + n
    if done:  # behind the last: straight on
        k = min(len(x) - i, len(y) - j)
        same = np.flatnonzero(x[i : i + k] == y[j : j + k])
        to[i + same] = j + same
    return to


def stretches(equal: np.ndarray, words: int, similarity: float) -> list[tuple[int, int]]:
    """Stretches [a, b) of at least `words` words, `similarity` of which are equal: the longest first, then what lies beside them.

    Unequal words at its ends go as long as `words` are left.  No such stretch lies wholly outside those returned.
    """
    out, todo = [], [(0, len(equal))]
    while todo:
        a, b = todo.pop()
        if b - a < words:
            continue
        run = np.append(0, np.cumsum(equal[a:b])) - similarity * np.arange(b - a + 1)
        top = np.maximum.accumulate(run[::-1])[::-1]  # the best end at or behind each place
        far = np.searchsorted(-top, 1e-9 - run, side="right") - 1
        i = int((far - np.arange(b - a + 1)).argmax())
        j = int(far[i])
        if j - i < words:
            continue
        while j - i > words and not equal[a + j - 1]:
            j -= 1
        while j - i > words and not equal[a + i]:
            i += 1
        out.append((a + i, a + j))
        todo += [(a, a + i), (a + j, b)]
    return sorted(out)


def compare(x: np.ndarray, y: np.ndarray, words: int, similarity: float) -> list[tuple[int, int, np.ndarray]]:
    """Passages [i, j) of word hashes x that y has too, with the places in y of their equal words."""
    if len(x) < SIZE or len(y) < SIZE:
        return []
    if len(x) == len(y) and (x == y).all():
        return [(0, len(x), np.arange(len(x)))] if len(x) >= words else []
    code = []
    for w in (x, y):
        h = shingle_hashes(w, SIZE)
        code.append(h ^ (occurrence(h).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)))
    _, a, c = np.intersect1d(*code, return_indices=True)
    order = np.argsort(a)
    a, c = a[order], c[order]
    k = thin(a, c) if len(a) else a
    a, c = a[k], c[k]
    out = []
    for chain in chains(WORD * a, WORD * c):
        to = align(x, y, list(zip(a[chain].tolist(), c[chain].tolist(), strict=True)))
        for i, j in stretches(to >= 0, words, similarity):
            out.append((i, j, to[i:j][to[i:j] >= 0]))
    return out


def repeated_passages(docs: DataFrame, words: int = 50, similarity: float = 0.8) -> DataFrame:
    """The passages of documents that repeat one of a document with a smaller doc_id."""
    return _passages(docs, words, similarity).select(*(c.split()[0] for c in SPANS.split(", ")))


def _passages(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Repeated passages; with v, a hash of the text, where a doc_id has several rows."""
    rows, what = nodes(docs)
    twice = copies(rows)
    marked = mark_maybe(rows, twice.select(F.col("node").alias("id")), "node", "maybe")
    unsure = marked.where("maybe").join(twice, "node", "left")
    once = marked.where("not maybe").select("node", "text").unionByName(unsure.where("rep is null").select("node", "text"))
    found = materialize(matches(once), "regions")
    asked = materialize(found.select(F.col("node").alias("id")).union(found.select("owner")).distinct(), "asked")
    texts = mark_maybe(rows, asked, "node", "asked").where("asked").select("node", F.col("text").cast("binary").alias("text"))
    cut = "substring(text, {0} + 1, {1} - {0} + {2})"
    near = found.withColumn("from", F.greatest(F.col("lo") - MARGIN, F.lit(0)).cast("int")).withColumn("owner_from", F.greatest(F.col("owner_lo") - MARGIN, F.lit(0)).cast("int"))
    near = near.join(texts.withColumnRenamed("node", "owner").hint("merge"), "owner").withColumn("y", F.expr(cut.format("owner_from", "cast(owner_hi as int)", MARGIN))).drop("text")
    near = near.join(texts.hint("merge"), "node").withColumn("x", F.expr(cut.format("from", "cast(hi as int)", MARGIN))).drop("text")
    near = near.select("node", "owner", "lo", "hi", "from", "owner_from", F.expr(f"hi + {MARGIN}").alias("to"), F.expr(f"owner_hi + {MARGIN}").alias("owner_to"), "x", "y")
    schema = "node long, start int, stop int, n_words int, n_equal int, owner long, owner_start int, owner_stop int"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, have = None, []
        for b in batches:
            out = []
            sides = {}
            for side in "xy":
                texts = b[side].tolist()
                got = []
                for i, j in helpings(texts):
                    h, f, e, n = word_hashes(texts[i:j])
                    base, at = np.cumsum([0, *(len(t) + 1 for t in texts[i:j])]), np.append(0, np.cumsum(n))
                    got += [(h[at[k] : at[k + 1]], f[at[k] : at[k + 1]] - base[k], e[at[k] : at[k + 1]] - base[k]) for k in range(j - i)]
                sides[side] = got
            order = np.lexsort((b["owner"].to_numpy(), b["node"].to_numpy()))
            columns = [b[c].tolist() for c in ("node", "owner", "lo", "hi", "from", "owner_from", "to", "owner_to")]
            for k in order.tolist():
                d, o, lo, hi, start, owner_start, to, owner_to = (c[k] for c in columns)
                if d != node:
                    node, have = d, []
                if any(p <= lo and hi < q for p, q in have):
                    continue
                hx, px, ex = _whole(*sides["x"][k], start, to)
                hy, py, ey = _whole(*sides["y"][k], owner_start, owner_to)
                for i, j, mine in compare(hx, hy, words, similarity):
                    have.append((int(px[i]), int(ex[j - 1])))
                    out.append((d, *have[-1], j - i, len(mine), o, int(py[mine.min()]), int(ey[mine.max()])))
            if out:
                yield pd.DataFrame(out, columns=names)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Copies from their first word to their last."""
        for b in batches:
            texts, out = b["text"].tolist(), []
            for i, j in helpings(texts):
                _, first, last, n = word_hashes(texts[i:j])
                base, at = np.cumsum([0, *(len(t) + 1 for t in texts[i:j])]), np.append(0, np.cumsum(n))
                for k in np.flatnonzero(n >= words).tolist():
                    p, q = int(first[at[k]] - base[k]), int(last[at[k + 1] - 1] - base[k])
                    out.append((b["node"].iat[i + k], p, q, int(n[k]), int(n[k]), b["rep"].iat[i + k], p, q))
            if out:
                yield pd.DataFrame(out, columns=names)

    equal = unsure.where("rep is not null").select("node", "rep", F.col("text").cast("binary").alias("text")).mapInPandas(lean(whole), schema)
    spans = near.mapInPandas(lean(run), schema).unionByName(equal)
    if what is None:
        return spans.withColumnRenamed("node", "doc_id").withColumnRenamed("owner", "owner_id")
    spans = spans.join(what, "node").join(what.select(F.col("node").alias("owner"), F.col("doc_id").alias("owner_id")), "owner")
    return spans.where("doc_id <> owner_id").drop("node", "owner")


def _whole(h: np.ndarray, first: np.ndarray, last: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the bytes [start, stop) of a text without those that the cut may have parted, and their bytes in the text."""
    i, j = 0, len(h)
    if j and start > 0 and first[0] == 0:
        i = 1
    if i < j and last[j - 1] + start >= stop:
        j -= 1
    return h[i:j], first[i:j] + start, last[i:j] + start


def _repeats(docs: DataFrame) -> bool:
    """Whether a doc_id has several rows (one small aggregate comes back)."""
    n, d = docs.where("doc_id is not null").agg(F.count("doc_id"), F.countDistinct("doc_id")).first()
    return n != d


def remove_passages(docs: DataFrame, words: int = 50, similarity: float = 0.8) -> DataFrame:
    """The documents with their repeated passages cut out of `text`; all other columns stay.

    Passages that several owners share are merged before they are cut.
    """
    spans = materialize(_passages(docs, words, similarity), "spans")
    keys = ["doc_id", "v"] if "v" in spans.columns else ["doc_id"]
    # Spans of one document lie within its text, so the list is bounded by the text.
    list_, id_, v_ = fresh(docs, "_cuts"), fresh(docs, "_cut_id"), fresh(docs, "_cut_v")
    names = [id_, v_][: len(keys)]
    cuts = spans.select(*keys, "start", "stop").distinct().groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(list_))
    flag = fresh(docs, "_maybe")
    marked = mark_maybe(docs, spans.select(F.col("doc_id").alias("id")).distinct(), "doc_id", flag)
    unsure = marked.where(F.col(flag))
    same = unsure["doc_id"].cast("long") == cuts[id_]
    if len(keys) > 1:
        same &= F.md5(F.coalesce(unsure["text"].cast("string"), F.lit(""))) == cuts[v_]
    merged = unsure.join(cuts, same, "left")

    @F.pandas_udf("string")
    def without(text: pd.Series, cut: pd.Series) -> pd.Series:
        out = []
        for t, spans_ in zip(text, cut, strict=True):
            raw, at, kept = t.encode(), 0, []
            for s in spans_:
                a, b = s["start"], s["stop"]
                if b <= at:
                    continue
                kept.append(raw[at : max(a, at)])
                at = b
            out.append(b"".join([*kept, raw[at:]]).decode())
        return pd.Series(out, dtype=object)

    columns = [F.col(f"`{c}`") for c in docs.columns]
    changed = merged.where(F.col(list_).isNotNull()).withColumn("text", without("text", list_)).select(columns)
    untouched = marked.where(~F.col(flag)).select(columns)
    return untouched.unionByName(merged.where(F.col(list_).isNull()).select(columns)).unionByName(changed)
