"""Exact deduplication with Patricia tries as owners.

Texts are dealt by their length and a short hash of their content.  All texts of
such a bucket are inserted whole into one compressed radix trie; the terminal
node of a text keeps the best identifier seen, how many rows had it, and which
groups of rows, so equality is decided by bytes alone.  Each task first does the
same over its own rows, so a text repeated a billion times crosses the shuffle
once for each helping of a task.  A bucket whose trie outgrows its memory spills
by subtree: the texts go to one file per leading byte after the common stem, and
each file is then a trie of its own.  These files are scratch of one task, in its
own temporary folder; nothing else reads them, and a task that is run again makes
them anew.

A task's groups are numbered and written once; their rows get the result of their
group by its number, never by a hash.

Nulls count as empty and empty texts are equal to each other.  Rows repeated
with one doc_id count as rows.  A null doc_id loses to any other.  Very long texts
are one entry like any other.  An empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import tempfile
from array import array
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fresh, lean, materialize, tasks, without_ids

SPILL_BYTES = 128 << 20
#: Values of the short hash.
SHORT = 1 << 16


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Node:
    """A node of the trie: the bytes leading to it, its children by first byte, and its value if a text ends here."""

    __slots__ = ("label", "below", "value")

    def __init__(self, label: bytes, value=None):
        self.label, self.below, self.value = label, {}, value


class Trie:
    """Compressed radix trie from byte strings to [best id, rows, references]."""

    def __init__(self, better):
        self.root, self.size, self.better = Node(b""), 0, better

    def insert(self, text: bytes, best: int, rows: int, *refs) -> None:
        node, at = self.root, 0
        self.size += 8 * len(refs)
        while True:
            if at == len(text):
                if node.value is None:
                    node.value = [best, rows, list(refs)]
                else:
                    node.value[0] = self.better(node.value[0], best)
                    node.value[1] += rows
                    node.value[2] += refs
                return
            child = node.below.get(text[at])
            if child is None:
                node.below[text[at]] = Node(text[at:], [best, rows, list(refs)])
                self.size += len(text) - at + 300
                return
            rest = text[at : at + len(child.label)]
            if rest == child.label:
                node, at = child, at + len(rest)
                continue
            k = common_prefix(child.label, rest)
            upper = Node(child.label[:k])
            node.below[text[at]] = upper
            child.label = child.label[k:]
            upper.below[child.label[0]] = child
            self.size += 200
            node, at = upper, at + k

    def items(self) -> Iterator[tuple]:
        """All texts with their values: text, best, rows and the references."""
        stack = [(self.root, b"")]
        while stack:
            node, stem = stack.pop()
            text = stem + node.label
            if node.value is not None:
                yield text, *node.value[:2], *node.value[2]
            stack.extend((c, text) for c in node.below.values())


def owners(rows: Iterator[tuple], better, limit: int = SPILL_BYTES) -> Iterator[tuple]:
    """Distinct texts of one bucket with best id, row count and references (all longs); spills by subtree beyond `limit` bytes."""
    trie = Trie(better)
    for row in rows:
        trie.insert(*row)
        if trie.size > limit:
            break
    else:
        yield from trie.items()
        return
    node, stem = trie.root, b""
    while node.value is None and len(node.below) == 1:  # the stem all texts share
        node = next(iter(node.below.values()))
        stem += node.label
    depth = len(stem)
    with tempfile.TemporaryDirectory() as folder:
        files: dict[int, object] = {}
        short = Trie(better)

        def spill(text: bytes, *values: int):
            if not text.startswith(stem) or len(text) <= depth:
                short.insert(text, *values)
                return
            f = files.get(text[depth])
            if f is None:
                f = files[text[depth]] = open(os.path.join(folder, str(text[depth])), "w+b")  # noqa: SIM115
            f.write(len(text).to_bytes(8, "little") + len(values).to_bytes(8, "little") + array("q", values).tobytes() + text)

        for item in trie.items():
            spill(*item)
        del trie
        for row in rows:
            spill(*row)
        yield from short.items()

        def back(f):
            f.seek(0)
            while head := f.read(16):
                values = array("q", f.read(8 * int.from_bytes(head[8:], "little")))
                yield f.read(int.from_bytes(head[:8], "little")), *values

        for f in files.values():
            yield from owners(back(f), better, limit)
            f.close()
            os.unlink(f.name)


LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def exact_groups(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; `keep` says which doc_id of equal texts stays."""
    better, none = (max, LOWEST) if keep == "largest" else (min, HIGHEST)
    spark = docs.sparkSession
    rows = documents(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = rows.select("*", F.octet_length("text").alias("size"), F.pmod(F.xxhash64("text"), F.lit(SHORT)).cast("int").alias("short"))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Distinct texts of the rows a task has read, in bounded helpings."""
        tries: dict = {}
        held, group = 0, TaskContext.get().partitionId() << 33

        def out():
            nonlocal group
            full = []
            for (size, short), trie in tries.items():
                for text, best, n, *ids in trie.items():
                    full.append((group, size, short, text, best, n, ids))
                    group += 1
            return pd.DataFrame(full, columns=["group", "size", "short", "text", "best", "n", "ids"])

        for b in batches:
            for doc, text, size, short in zip(b["doc_id"], b["text"], b["size"].tolist(), b["short"].tolist(), strict=True):
                trie = tries.get((size, short))
                if trie is None:
                    trie = tries[size, short] = Trie(better)
                before, doc = trie.size, None if pd.isna(doc) else int(doc)
                trie.insert(text, none if doc is None else doc, 1, doc)
                held += trie.size - before
            if held > SPILL_BYTES // 4:
                yield out()
                tries, held = {}, 0
        if tries:
            yield out()

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come in order of (size, short): one bucket after another."""

        def stream():
            for b in batches:
                yield from zip(b["size"].tolist(), b["short"].tolist(), b["text"], b["best"].tolist(), b["n"].tolist(), b["group"].tolist(), strict=True)

        held = []
        for _, bucket in groupby(stream(), lambda r: r[:2]):
            for _, best, n, *groups in owners((r[2:] for r in bucket), better):
                held += [(g, best, n) for g in groups]
                if len(held) >= 10_000:
                    yield pd.DataFrame(held, columns=["group", "best", "group_size"])
                    held = []
        if held:
            yield pd.DataFrame(held, columns=["group", "best", "group_size"])

    groups = materialize(rows.mapInPandas(lean(local), "group long, size int, short int, text binary, best long, n long, ids array<long>"), "texts")
    dealt = groups.select("group", "size", "short", "text", "best", "n").repartition(tasks(spark), "size", "short").sortWithinPartitions("size", "short")
    owner = dealt.mapInPandas(lean(merge), "group long, best long, group_size long")
    each = groups.select("group", "ids", F.sha2("text", 256).alias("text_sha256")).join(owner, "group")
    keep_id = F.when(F.col("best") != none, F.col("best"))
    out = each.select(F.explode("ids").alias("doc_id"), keep_id.alias("keep_id"), "group_size", "text_sha256")
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The documents that stay, one row each, with all their columns; rows with a null doc_id go where another row has their text."""
    n, ids = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    groups = exact_groups(docs, keep)
    if n == ids:
        return without_ids(docs, groups.where("not kept").select(F.col("doc_id").alias("id")))
    hash_ = fresh(docs, "_hash")
    rows = docs.withColumn(hash_, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    stay = groups.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    kept = rows.join(stay, (rows["doc_id"] == stay["_id"]) & (rows[hash_] == stay["_sha"]), "left_semi").drop(hash_)
    nameless = groups.where("keep_id is null").select(F.col("text_sha256").alias("_sha")).distinct()
    rest = rows.where(rows["doc_id"].isNull()).join(nameless, rows[hash_] == nameless["_sha"], "left_semi").drop(hash_)
    return kept.dropDuplicates(["doc_id", "text"]).unionByName(rest.dropDuplicates(["text"]))
