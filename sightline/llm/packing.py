"""Packing along a space-filling curve.

A document's token counts, hashed to a short vector, are projected to a few
dimensions; the cell they fall in gives a Hilbert key.  Documents are
range-sorted by (key, doc_id), so that neighbours on the curve meet in one
sequence.  Ranges hold about as many tokens each: they are cut from the token
sums of the key's leading bits, and where one such cell (copies of one text,
say) holds more than a range it is dealt by doc_id over several.  Within a
range documents are laid end to end into sequences of `size` tokens; a document is
cut where a sequence is full.  What is left at the end of a task's range fills
sequences whose lengths are powers of two, so nothing is padded.

Nulls and empty texts hold the end id alone.  Repeated rows are packed each by
itself.  A null doc_id sorts first within its key.  An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, lean, materialize, tasks
from .tokens import tokens

DIMENSIONS, BITS, HASHED = 4, 12, 512
#: Leading bits of the key that tell the cells by which ranges are cut.
CELL_BITS = 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (n by d, below 2**bits), by Gray-code transposition."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[d - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert key of each document from its token ids."""
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64)
    bucket = (flat * 2654435761 >> 7) % HASHED
    counts = np.bincount(np.repeat(np.arange(len(ids)), size) * HASHED + bucket, minlength=len(ids) * HASHED).reshape(len(ids), HASHED)
    vector = np.sqrt(counts / np.maximum(1, size)[:, None]) - 1 / np.sqrt(HASHED)
    axes = np.linalg.qr(np.random.default_rng(5).standard_normal((HASHED, DIMENSIONS)))[0]
    at = 1 / (1 + np.exp(-vector @ axes * 16))
    return hilbert(np.minimum((at * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def ranges(coded: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First range of each cell of the curve, and over how many ranges the cell is dealt.

    At most 2 ** CELL_BITS sums come to the driver.
    """
    cell = F.shiftright("key", DIMENSIONS * BITS - CELL_BITS).cast("int")
    total = np.zeros(1 << CELL_BITS)
    for r in coded.groupBy(cell.alias("cell")).agg(F.sum("n").alias("n")).collect():
        total[r["cell"]] = r["n"]
    share = max(1.0, total.sum() / n)
    parts = np.maximum(1, np.round(total / share)).astype(np.int64)
    first, used, held = np.zeros(len(total), np.int64), 0, 0.0
    for c in np.flatnonzero(total):
        if held and held + total[c] > 1.2 * share:
            used, held = used + 1, 0.0
        first[c] = used
        held += total[c]
        if parts[c] > 1:
            used, held = used + int(parts[c]), 0.0
    return first, parts


def tail(left: int) -> list[int]:
    """Lengths of the last sequences: the powers of two that make up `left`."""
    return [1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1]


def pack(docs: DataFrame, vocabulary: str, end_id: int, size: int = 4096, words: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    spark = docs.sparkSession

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in batches:
            ids = tokens(vocabulary, words, True).encode(b["text"].tolist())
            yield pd.DataFrame({"key": curve_keys(ids), "doc_id": b["doc_id"], "n": [len(x) + 1 for x in ids], "ids": [squeeze.compress(np.append(x, end_id).astype("<u4").tobytes()) for x in ids]})

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sequences are numbered within the task's part, and the parts by their own number."""
        loosen = zstandard.ZstdDecompressor()
        sequence, used, rows, held = TaskContext.get().partitionId() << 36, 0, [], []

        def piece(doc, ids, start, stop, into, offset):
            return None if pd.isna(doc) else int(doc), start, stop - start, zlib.crc32(ids[start:stop].tobytes()), len(ids), into, offset

        def frame(rows):
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")])
            return out.astype({"doc_id": "Int64"})

        # `held`: the pieces of the sequence being filled, as (doc_id, ids, start).
        for b in batches:
            for doc, data in zip(b["doc_id"], b["ids"], strict=True):
                ids, at = np.frombuffer(loosen.decompress(data), "<u4"), 0
                while used + len(ids) - at >= size:
                    stop, offset = at + size - used, 0
                    for d, x, start in held:
                        rows.append(piece(d, x, start, len(x), sequence, offset))
                        offset += len(x) - start
                    rows.append(piece(doc, ids, at, stop, sequence, used))
                    held, used, at, sequence = [], 0, stop, sequence + 1
                if at < len(ids):
                    held.append((doc, ids, at))
                    used += len(ids) - at
            if rows:
                yield frame(rows)
                rows = []
        # The rest, below `size`, in sequences of powers of two.
        lengths, rows, offset = tail(used), [], 0
        for doc, ids, start in held:
            while start < len(ids):
                n = min(len(ids) - start, lengths[0] - offset)
                rows.append(piece(doc, ids, start, start + n, sequence, offset))
                start, offset = start + n, offset + n
                if offset == lengths[0]:
                    lengths, offset, sequence = lengths[1:], 0, sequence + 1
        if rows:
            yield frame(rows)

    coded = materialize(documents(docs).mapInPandas(lean(encode), "key long, doc_id long, n long, ids binary"), "packing")
    first, parts = ranges(coded, tasks(spark))

    def place(keys: pd.Series, ids: pd.Series) -> pd.Series:
        cell = keys.to_numpy() >> (DIMENSIONS * BITS - CELL_BITS)
        return pd.Series((first[cell] + ids.to_numpy() % parts[cell]).astype(np.int32))

    spot = F.pandas_udf(place, "int")(F.col("key"), F.coalesce(F.xxhash64("doc_id"), F.lit(0)))
    dealt = coded.withColumn("range", spot).repartitionById(int((first + parts).max()), F.col("range"))
    return dealt.drop("range").sortWithinPartitions("key", "doc_id", "n").mapInPandas(lean(lay), PIECES)
