"""Token-id files with fixed-width bit packing.

The file is a Parquet table in which a row is a block of whole documents:

    shard, block        place in the file; shards are ranges of doc_id
    width               bits of an id, the least that hold the vocabulary
    n_ids               ids in the block
    first               ids before the block in its shard
    doc_ids, starts     its documents in order (none listed: all null), and where each begins in it
    payload             id i in bits [i * width, (i + 1) * width), low bit first

A block unpacks with array operations, and (block, start) reaches any document
without the others.  Documents stand in ascending doc_id order (null first).

Nulls and empty texts hold the end id alone; repeated rows each get their own
place; an empty table makes an empty file; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, lean, materialize, tasks
from .tokens import tokens

BLOCK_IDS = 1 << 18
LAYOUT = "shard int, block int, width int, first long, n_ids long, doc_ids array<long>, starts array<long>, payload binary"


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in `width` bits each, low bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, a: int, b: int) -> np.ndarray:
    """Ids [a, b) of a packed block, reading only their bytes."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", b - a, a * width // 8).astype(np.uint32)
    first = a * width // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, (b * width + 7) // 8 - first, first), bitorder="little")
    bits = bits[a * width - first * 8 :][: (b - a) * width].reshape(-1, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32)


def blocks(docs: DataFrame, vocabulary: str, end_id: int, words: bool = False) -> DataFrame:
    """The file's rows: ids of every whole text and end_id behind each, in doc_id order."""
    rows, n = documents(docs), tasks(docs.sparkSession)
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    cuts = np.unique(np.array(cuts or [], np.int64))
    width = max(1, int(len(tokens(vocabulary, words, True).names)).bit_length())

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in batches:
            ids = tokens(vocabulary, words, True).encode(b["text"].tolist())
            doc = b["doc_id"].to_numpy()
            known = pd.notna(doc)
            shard = np.zeros(len(b), np.int32)
            shard[known] = np.searchsorted(cuts, doc[known].astype(np.int64))
            yield pd.DataFrame({"shard": shard, "doc_id": b["doc_id"], "ids": [squeeze.compress(np.append(x, end_id).astype("<u4" if width > 16 else "<u2").tobytes()) for x in ids]})

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loosen = zstandard.ZstdDecompressor()
        held, doc_ids, size, shard, block, first, null = [], [], 0, None, 0, 0, False

        def out():
            starts = np.cumsum([0, *map(len, held)])
            return pd.DataFrame([(shard, block, width, first, int(starts[-1]), [] if null else list(doc_ids), starts[:-1].tolist(), pack(np.concatenate(held), width))], columns=[x.split()[0] for x in LAYOUT.split(", ")])

        for b in batches:
            for s, d, data in zip(b["shard"].tolist(), b["doc_id"], b["ids"], strict=True):
                if held and (s != shard or size >= BLOCK_IDS or null != pd.isna(d)):
                    yield out()
                    held, doc_ids, size, block, first = [], [], 0, block + 1, first + size
                if s != shard:
                    shard, block, first = s, 0, 0
                null = bool(pd.isna(d))
                held.append(np.frombuffer(loosen.decompress(data), "<u4" if width > 16 else "<u2"))
                doc_ids.append(None if null else int(d))
                size += len(held[-1])
        if held:
            yield out()

    coded = rows.mapInPandas(lean(encode), "shard int, doc_id long, ids binary")
    dealt = coded.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first())
    return dealt.mapInPandas(lean(write), LAYOUT)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Write the file at a path that Spark's writers reach."""
    blocks(docs, vocabulary, end_id).write.option("compression", "zstd").parquet(path)


def read(table: DataFrame) -> DataFrame:
    """Each document of a file read back: doc_id, start (ids before it in the file), n_tokens, ids_crc32."""
    totals = {r["shard"]: r["n"] for r in table.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}  # a row per shard
    ahead = dict(zip(sorted(totals), np.cumsum([0, *[totals[s] for s in sorted(totals)]]).tolist(), strict=False))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                bounds = [*map(int, r.starts), int(r.n_ids)]
                ids = unpack(r.payload, int(r.width), 0, int(r.n_ids))
                bounds = np.array(bounds, np.int64)
                doc = pd.array(r.doc_ids if len(r.doc_ids) else [None] * (len(bounds) - 1), "Int64")
                yield pd.DataFrame({"doc_id": doc, "start": ahead[r.shard] + int(r.first) + bounds[:-1], "n_tokens": np.diff(bounds), "ids_crc32": [zlib.crc32(ids[x:y].astype("<u4")) for x, y in zip(bounds, bounds[1:], strict=False)]})

    return table.mapInPandas(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write the file in the shared folder and read it back."""
    return read(materialize(blocks(docs, vocabulary, end_id), "token_file"))
