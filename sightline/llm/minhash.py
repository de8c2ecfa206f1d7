"""MinHash near-deduplication with tensored banding.

Two small collections of band hashes, U and V, are computed for each shingle
set, and a table key is a pair (U_i, V_j): with m hashes in each collection
there are m * m tables for 2m band computations (4m minhashes in all).  At
similarity s a pair is missed with a probability below 2 * (1 - s**2)**m.  The
limit sets m so that a pair at it is missed with at most 1e-5: 10 at 0.85 (5e-6
there, 1e-7 at 0.9), 12 at 0.8.

Equal sets are one representative first.  Representatives are dealt by table key.
The documents of a key give a star, each with the least of them, so rows and not
pairs are counted; a task does so for keys that are frequent in it before the
shuffle and passes on the least document alone.  The distinct edges of all stars
are pruned by their minhashes (a linked pair falls below with a probability of
2e-7) and confirmed on full sets.

A star edge that is not confirmed may hide a link between others of its key.  So
the documents of keys with such an edge are looked at again, dealt by U_i: those
with the most common minhashes give stars, then documents outside the largest
component of their U_i name their nearest four in other components, and last all
in other components.  What is found is confirmed between these steps.  Pairs are
left out whose shingles that no other of these documents has, or at last whose
sets of half hashes, rule a link out.  No link between components is lost.

Texts without words (null, empty, white space) have an empty set and link with
nothing.  Rows with a null doc_id link with nothing and have no component.  Rows
repeated under one doc_id count once as nodes and each give a row.  Very long
texts count whole; equally near partners are taken by doc_id.  An empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, documents, lean, mark_maybe, materialize, tasks, without_ids
from .shingles import helpings, shingle_sets

#: Minhashes of a band, and the most of a document.
ROWS, MOST = 2, 256
#: Documents of one key in a task beyond which their star is made before the shuffle; table entries held at a time; documents compared in a block.
MANY, FLUSH, BLOCK = 16, 600_000, 512
_factors = np.random.default_rng(41).integers(1 << 62, 1 << 63, MOST).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def bands(percent: int) -> int:
    """How many bands in each collection (m) miss a pair at the limit with a probability of at most 1e-5."""
    m, s = 1, percent / 100
    while 2 * (1 - s**ROWS) ** m > 1e-5 and 2 * (m + 1) * ROWS <= MOST:
        m += 1
    return m


def least_agreeing(percent: int) -> int:
    """The most of a document's minhashes of which a pair at the limit shares fewer with a probability of at most 2e-7."""
    n = 2 * ROWS * bands(percent)
    s, k, below = percent / 100, 0, 0.0
    while k < n:
        below += math.comb(n, k) * s**k * (1 - s) ** (n - k)
        if below > 2e-7:
            break
        k += 1
    return k


def minhashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """The least of each permuted set: a row of n per set, which must not be empty."""
    flat = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), n), np.uint64)
    for k in range(n):
        out[:, k] = np.minimum.reduceat(flat * _factors[k], first)
    return out


def band_hashes(low: np.ndarray) -> np.ndarray:
    """U and V: the hash of each ROWS minhashes in turn."""
    out = np.empty((len(low), low.shape[1] // ROWS), np.uint64)
    for i in range(out.shape[1]):
        h = np.full(len(low), i + 1, np.uint64)
        for r in range(ROWS):
            h = (h ^ low[:, i * ROWS + r]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(30)
        out[:, i] = h * np.uint64(0xBF58476D1CE4E5B9)
    return out


def table_keys(bands_: np.ndarray) -> np.ndarray:
    """The keys (U_i, V_j) of each row of band hashes: m * m of them."""
    m = bands_.shape[1] // 2
    h = (bands_[:, :m, None] ^ (bands_[:, None, m:] >> np.uint64(17))) * np.uint64(0xD6E8FEB86659FD93) + bands_[:, None, m:]
    h ^= h >> np.uint64(29)
    return (h * np.uint64(0x9E3779B97F4A7C15)).reshape(len(bands_), m * m)


def signatures(docs: DataFrame, size: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes), bands (U and V, packed longs) and signature (two bytes of each minhash) of each whole text."""
    n = 2 * ROWS * bands(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            for i, j in helpings(texts):
                sets = shingle_sets(texts[i:j], size)
                some = [k for k, s in enumerate(sets) if len(s)]
                keys, sig = [None] * len(sets), [None] * len(sets)
                if some:
                    low = minhashes([sets[k] for k in some], n)
                    u = band_hashes(low)
                    s = ((low * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.uint16)
                    for r, k in enumerate(some):
                        keys[k], sig[k] = u[r].tobytes(), s[r].tobytes()
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[i:j].array, "n_shingles": [len(s) for s in sets], "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], "bands": keys, "signature": sig})

    rows = documents(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInPandas(lean(run), "doc_id long, n_shingles long, set_key binary, bands binary, signature binary")


def star(key: np.ndarray, id_: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b, key) of each key's documents with the least of them, and the places of entries to go on.

    Unless this is the last time a key is looked at, only keys of more than MANY documents give edges; of these the least document goes on.
    """
    order = np.lexsort((id_, key))
    k, i = key[order], id_[order]
    begins = np.append(True, k[1:] != k[:-1])
    first = np.flatnonzero(begins)
    group = np.cumsum(begins) - 1
    count = np.diff(np.append(first, len(k)))[group]
    done = (count > (1 if last else MANY)) & ~begins
    at = np.flatnonzero(done & (i != i[first[group]]))
    edges = np.stack([i[first[group[at]]], i[at], k[at].view(np.int64)], 1)
    return edges, np.sort(order[~done]) if not last else order[:0]


def stars(reps: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b, key), a < b, of the stars of all table keys of reps(id, bands)."""
    spark = reps.sparkSession
    m, buckets = bands(percent), 4 * tasks(spark)

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, turn = [], 0, 0

        def flush():
            key, id_ = map(np.concatenate, zip(*held, strict=True))
            edges, on = star(key, id_, False)
            key, id_ = key[on], id_[on]
            bucket = ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
            order = np.argsort(bucket, kind="stable")
            key, id_ = key[order], id_[order]
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            # Ids ascend within a bucket, so their differences are small numbers.
            out = [(k, False, key[cut[k] : cut[k + 1]].tobytes(), np.diff(id_[cut[k] : cut[k + 1]], prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes()) for k in np.flatnonzero(np.diff(cut)).tolist()]
            if len(edges):
                out.append((turn % buckets, True, edges.tobytes(), b""))
            return pd.DataFrame(out, columns=["bucket", "edges", "data", "ids"])

        for b in batches:
            b = b.sort_values("id")
            for at in range(0, len(b), 4096):
                part = b.iloc[at : at + 4096]
                key = table_keys(np.frombuffer(b"".join(part["bands"]), np.uint64).reshape(len(part), 2 * m))
                id_ = part["id"].to_numpy(np.int64)
                turn = turn or int(id_[0] & 0xFFFF)
                held.append((key.ravel(), np.repeat(id_, m * m)))
                size += key.size
                if size >= FLUSH:
                    yield flush()
                    held, size, turn = [], 0, turn + 1
        if held:
            yield flush()

    def meet(batches):
        import pyarrow as pa

        held, size, now = [], 0, None

        def out(edges):
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in edges.T], ["a", "b", "key"])

        for b in batches:
            for bucket, is_edges, data, ids in zip(b.column("bucket").to_pylist(), b.column("edges").to_pylist(), b.column("data"), b.column("ids"), strict=True):
                if is_edges:
                    yield out(np.frombuffer(data.as_py(), np.int64).reshape(-1, 3))
                    continue
                if held and bucket != now:
                    yield out(star(*map(np.concatenate, zip(*held, strict=True)), True)[0])
                    held, size = [], 0
                now = bucket
                key = np.frombuffer(data.as_py(), np.uint64)
                held.append((key, np.cumsum(np.ascontiguousarray(np.frombuffer(ids.as_py(), np.uint8).reshape(8, -1).T).view(np.int64).ravel())))
                size += len(key)
                if size > 2 * FLUSH:  # frequent keys need not pile up
                    key, id_ = map(np.concatenate, zip(*held, strict=True))
                    edges, on = star(key, id_, False)
                    yield out(edges)
                    held = [(key[on], id_[on])]
                    size = size // 2 if len(on) > FLUSH else len(on)
        if held:
            yield out(star(*map(np.concatenate, zip(*held, strict=True)), True)[0])

    dealt = reps.select("id", "bands").mapInPandas(lean(table), "bucket int, edges boolean, data binary, ids binary")
    return dealt.repartition(tasks(spark), "bucket").sortWithinPartitions("edges", "bucket").mapInArrow(lean(meet), "a long, b long, key long")


def sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """id and whole shingle set (array of long) of the documents in ids(id)."""
    texts = mark_maybe(documents(docs).where("doc_id is not null"), ids, "doc_id", "asked").where("asked")
    texts = texts.join(ids, texts["doc_id"] == ids["id"], "left_semi").select("doc_id", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            for i, j in helpings(texts):
                yield pd.DataFrame({"id": b["doc_id"].to_numpy(np.int64)[i:j], "shingles": [x.view(np.int64) for x in shingle_sets(texts[i:j], size)]})

    return materialize(texts.mapInPandas(lean(run), "id long, shingles array<long>"), "sets")


def shingles_alone(sets: DataFrame) -> DataFrame:
    """id and alone of sets(id, shingles): how many of a set's shingles no other of them has."""
    each = sets.select("id", F.explode("shingles").alias("shingle"))
    return each.groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("last")).where("id = last").groupBy("id").agg(F.count("*").alias("alone"))


def images(sets: DataFrame) -> DataFrame:
    """id and image: the distinct upper halves of a set's hashes, ascending."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "image": [np.unique((np.asarray(x, np.int64).view(np.uint64) >> np.uint64(32)).astype(np.uint32)).tobytes() for x in b["shingles"]]})

    return sets.mapInPandas(lean(run), "id long, image binary")


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


def grouped(batches, columns: list[str]) -> Iterator[tuple[tuple, dict]]:
    """Runs of equal values of the first columns but the last six (those of a member), as arrays."""
    keys, left = columns[:-6], None
    for b in batches:
        now = {c: b.column(c).to_numpy(zero_copy_only=False) for c in columns[:-2]} | {c: _objects(b.column(c).to_pylist()) for c in columns[-2:]}
        if left is not None:
            now = {c: np.concatenate([left[c], now[c]]) for c in columns}
        n = len(now["id"])
        if not n:
            continue
        cut = np.flatnonzero(np.logical_or.reduce([now[c][1:] != now[c][:-1] for c in keys])) + 1
        begun = [0, *cut.tolist()]
        for i, j in zip(begun, cut.tolist(), strict=False):
            yield tuple(now[c][i] for c in keys), {c: now[c][i:j] for c in columns}
        left = {c: now[c][begun[-1] :] for c in columns}
    if left is not None:
        yield tuple(left[c][0] for c in keys), left


def _shared(x: np.ndarray, y: np.ndarray, turn: int, least: int) -> np.ndarray:
    """Whether signatures x and y (n rows each) agree often enough, share a table key, and have band `turn` of U as their first in common."""
    same = x == y
    bands_ = same[:, 0::ROWS] & same[:, 1::ROWS]
    m = bands_.shape[1] // 2
    return (same.sum(1) >= least) & bands_[:, m:].any(1) & bands_[:, turn] & ~bands_[:, :turn].any(1)


def _may_link(n: np.ndarray, common: np.ndarray, other_n: np.ndarray, other_common: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and other_n shingles, of which other documents have `common`, can reach the limit; n is negative where an id has several sets."""
    both = np.minimum(common, other_common)
    return (100 * both >= percent * (n + other_n - both)) | (n < 0) | (other_n < 0)


def _image_may_link(x: dict, y: dict, row: np.ndarray, col: np.ndarray, percent: int) -> np.ndarray:
    """Whether the images of sets let a pair reach the limit: they share as much as the sets do, but for hashes that fall together in both."""
    mine, theirs = ([np.frombuffer(i, np.uint32) for i in g["image"]] for g in (x, y))
    out = np.ones(len(row), bool)
    for k, (i, j) in enumerate(zip(row.tolist(), col.tolist(), strict=True)):
        n, m = int(x["n"][i]), int(y["n"][j])
        if n >= 0 and m >= 0:
            both = len(np.intersect1d(mine[i], theirs[j], assume_unique=True)) + min(n - len(mine[i]), m - len(theirs[j]))
            out[k] = 100 * both >= percent * (n + m - both)
    return out


def _pairs(x: dict, y: dict, turn: int, least: int, most: int | None, percent: int) -> pd.DataFrame:
    """Pairs (a, b) of rows of two blocks in different components that `_shared` holds for; of each row of x the `most` nearest."""
    s, t = (np.frombuffer(b"".join(g["signature"]), np.uint16).reshape(len(g["id"]), -1) for g in (x, y))
    row, col, near = [], [], []
    step = max(1, (1 << 23) // t.size)
    for i in range(0, len(s), step):
        agree = (s[i : i + step, None, :] == t[None, :, :]).sum(2, dtype=np.int16)
        r, c = np.nonzero((agree >= least) & (x["part"][i : i + step, None] != y["part"][None, :]))
        near.append(agree[r, c])
        row.append(i + r)
        col.append(c)
    row, col, near = map(np.concatenate, (row, col, near))
    may = _may_link(x["n"][row], x["common"][row], y["n"][col], y["common"][col], percent)
    row, col, near = row[may], col[may], near[may]
    ok = np.zeros(len(row), bool)
    for i in range(0, len(row), 100_000):
        ok[i : i + 100_000] = _shared(s[row[i : i + 100_000]], t[col[i : i + 100_000]], turn, least)
    row, col, near = row[ok], col[ok], near[ok]
    if len(row) and x["image"][0] is not None:
        may = _image_may_link(x, y, row, col, percent)
        row, col, near = row[may], col[may], near[may]
    if most is not None:
        order = np.lexsort((y["id"][col], -near, row))
        row, col = row[order], col[order]
        few = np.arange(len(row)) - np.searchsorted(row, row, side="left") < most
        row, col = row[few], col[few]
    a, b = x["id"][row], y["id"][col]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _middle(g: dict, turn: int, least: int, percent: int) -> pd.DataFrame:
    """Pairs of a block's rows with that which agrees most with the commonest minhashes."""
    s = np.frombuffer(b"".join(g["signature"]), np.uint16).reshape(len(g["id"]), -1)
    votes = np.zeros(len(s), np.int64)
    for c in s.T:
        values, place, count = np.unique(c, return_inverse=True, return_counts=True)
        votes += place == count.argmax()
    k = int(votes.argmax())
    at = np.flatnonzero((g["part"] != g["part"][k]) & _may_link(g["n"], g["common"], g["n"][k], g["common"][k], percent))
    at = at[_shared(s[at], np.broadcast_to(s[k], (len(at), s.shape[1])), turn, least)]
    return pd.DataFrame({"a": np.minimum(g["id"][at], g["id"][k]), "b": np.maximum(g["id"][at], g["id"][k])})


def between_components(members: DataFrame, how: str, percent: int, image: DataFrame) -> DataFrame:
    """Pairs (a, b) of members(id, part, n, common, signature) that share a table key and are in different components.

    Members are dealt by U_i, and a pair is looked at for the first U_i it shares.
    how: "middle" gives all pairs of few documents, and of more those with the
    one in the middle of each block; "nearest" for each document outside the
    largest component of its U_i the nearest four in each block; "all" all whose
    images (id, image) let them link.  Only documents outside the largest
    component are dealt to all blocks.
    """
    spark = members.sparkSession
    least, m = least_agreeing(percent), bands(percent)
    member = ["id", "part", "n", "common", "signature"]

    def explode(batches):
        import pyarrow as pa

        for b in batches:
            s = np.frombuffer(b"".join(b.column("signature").to_pylist()), np.uint32).reshape(b.num_rows, 2 * m)[:, :m] if b.num_rows else np.zeros((0, m), np.uint32)
            key = (s.astype(np.int64) + (np.arange(m, dtype=np.int64) << 32)).ravel()
            at = pa.array(np.repeat(np.arange(b.num_rows), m))
            yield pa.RecordBatch.from_arrays([pa.array(key), *(b.column(c).take(at) for c in member)], ["key", *member])

    rows = materialize(members.select(*member).mapInArrow(lean(explode), "key long, id long, part long, n long, common long, signature binary"), "bands")
    sizes = rows.groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("part", F.struct("n", "part")).alias("main"))
    sizes = sizes.where("most < n").select("key", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("others"))
    rows = rows.join(materialize(sizes, "sizes"), "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    if how == "middle":
        rows = rows.select("key", "block", F.lit(0).alias("other"), F.lit(False).alias("side"), *member)
    else:
        every = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).withColumn("side", F.lit(False))
        out = rows.where("part <> main").withColumn("other", F.pmod(F.xxhash64("part", "id"), F.col("others")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(True))
        rows = every.unionByName(out).select("key", "block", "other", "side", *member)
    rows = rows.join(image, "id") if how == "all" else rows.withColumn("image", F.lit(None).cast("binary"))
    columns = ["key", "block", "other", "side", *member, "image"]
    rows = rows.select(columns)

    def run(batches):
        import pyarrow as pa

        held, size, all_ = None, 0, []

        def found():
            return pa.RecordBatch.from_pandas(pd.concat(all_).drop_duplicates(), preserve_index=False)

        for (key, block, other, side), g in grouped(batches, columns):
            turn = int(key) >> 32
            if how == "middle":
                got = _pairs(g, g, turn, least, None, percent) if len(g["id"]) <= 8 else _middle(g, turn, least, percent)
            elif not side:
                held = (key, block, other), g
                continue
            elif held is None or held[0] != (key, block, other):
                continue
            else:
                got = _pairs(g, held[1], turn, least, 4 if how == "nearest" else None, percent)
            if len(got):
                all_.append(got)
                size += len(got)
            if size > 50_000:
                yield found()
                size, all_ = 0, []
        if all_:
            yield found()

    dealt = rows.repartition(tasks(spark), "key", "block", "other").sortWithinPartitions("key", "block", "other", "side", "id")
    return dealt.mapInArrow(lean(run), "a long, b long").distinct()


def agreeing(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs whose minhashes agree often enough."""
    least = least_agreeing(percent)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in ("x", "y"))
            keep = (x == y).sum(1) >= least if b.num_rows else np.zeros(0, bool)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    both = pairs.join(reps.select(F.col("id").alias("a"), F.col("signature").alias("x")), "a").join(reps.select(F.col("id").alias("b"), F.col("signature").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


def confirm(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    Only texts that a bit map does not rule out are shuffled; the texts of a
    pair meet, and their sets are made there.
    """
    asked = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "asked")
    texts = mark_maybe(documents(docs).where("doc_id is not null"), asked, "doc_id", "asked").where("asked").select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")).hint("merge"), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")).hint("merge"), "a")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b, x, y = (batch[c].tolist() for c in ("a", "b", "x", "y"))
            keep = np.zeros(len(a), bool)
            for i, j in helpings(y):
                fresh = [k for k in range(i, j) if k == i or a[k] != a[k - 1] or x[k] != x[k - 1]]
                sets = shingle_sets([*(x[k] for k in fresh), *y[i:j]], size)
                new, now = set(fresh), -1
                for k in range(i, j):
                    now += k in new
                    p, q = sets[now], sets[len(fresh) + k - i]
                    shared = len(np.intersect1d(p, q, assume_unique=True))
                    keep[k] = 100 * shared >= percent * (len(p) + len(q) - shared)
            yield batch[["a", "b"]][keep]

    return materialize(rows.select("a", "b", "x", "y").mapInPandas(lean(run), "a long, b long"), "links")


def near_groups(docs: DataFrame, percent: int = 85, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    sig = materialize(signatures(docs, size, percent), "signatures")
    reps = sig.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    reps = materialize(reps, "representatives")
    edges = materialize(stars(reps, percent), "stars")
    named = materialize(edges.select("a", "b").distinct(), "named")
    pairs = materialize(agreeing(named, reps, percent), "pairs")
    links = confirm(docs, pairs, size, percent)
    part = materialize(components(links), "components")

    def parted(rows: DataFrame, name: str) -> DataFrame:
        known = part.select(F.col("id").alias(name), F.col("component_id").alias(f"part_{name}"))
        return rows.join(known, name, "left").withColumn(f"part_{name}", F.coalesce(f"part_{name}", name))

    failed = materialize(parted(parted(named, "a"), "b").where("part_a <> part_b").select("a", "b"), "failed")
    if not failed.isEmpty():
        keys = materialize(edges.join(failed, ["a", "b"], "left_semi").select("key").distinct(), "keys")
        again = edges.join(keys, "key", "left_semi")
        members = again.select(F.col("a").alias("id")).union(again.select("b")).distinct()
        # A set at the limit with any other has as great a share of shingles that others have.
        n = sig.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.when(F.min("set_key") == F.max("set_key"), F.max("n_shingles")).otherwise(-1).alias("n"))
        members = materialize(members, "open")
        sets = sets_of(docs, members, size)
        members = members.join(reps.select("id", "signature"), "id").join(n, "id").join(shingles_alone(sets), "id", "left").withColumn("common", F.when(F.col("n") >= 0, F.col("n") - F.coalesce("alone", F.lit(0))).otherwise(-1))
        members = materialize(members.where((100 * F.col("common") >= percent * F.col("n")) | (F.col("n") < 0)).select("id", "n", "common", "signature"), "members")
        image = images(sets.join(members.select("id"), "id", "left_semi")).dropDuplicates(["id"])
        for how in ("middle", "nearest", "all"):
            found = between_components(parted(members, "id").withColumnRenamed("part_id", "part"), how, percent, image)
            new = materialize(found.join(pairs, ["a", "b"], "left_anti"), "pairs")
            if new.isEmpty():
                continue
            links, pairs = links.union(confirm(docs, new, size, percent)), pairs.union(new)
            part = materialize(components(links), "components")
    member = sig.join(reps.select("set_key", "id"), "set_key", "left").join(part, "id", "left")
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("component_id", "id"))
    out = member.select("doc_id", "n_shingles", F.coalesce(own, F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_copies(docs: DataFrame, percent: int = 85, size: int = 5) -> DataFrame:
    """One document of each group, with all its columns; rows with a null doc_id stay."""
    gone = near_groups(docs, percent, size).where("not kept and doc_id is not null").select(F.col("doc_id").alias("id"))
    return without_ids(docs, gone)
