"""Byte-level BPE encoding and decoding.

Every match of the split pattern is merged by itself.  A segment tree over a
piece's byte positions keeps the leftmost least pair rank at its root; a merge
changes three leaves (the pair, the one swallowed, the live neighbour before)
and the logarithmically many nodes above them.  Trees of many pieces lie side
by side in one array (pieces.Merges), and a piece met before is looked up.

Nulls and empty texts encode to no ids.  Repeated rows give repeated results.
Other columns are ignored.  A text of any length is encoded whole: it is cut
only where a piece begins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import documents, lean
from .tokens import tokens


def encode(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id and ids (array of int) of each whole text, no special tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": tokens(ranks, False, False).encode(b["text"].tolist())})

    return documents(docs).mapInPandas(lean(run), "doc_id long, ids array<int>")


def decode(names: list[bytes], ids: list[int]) -> bytes:
    """The bytes that the ids stand for."""
    return b"".join(map(names.__getitem__, ids))


def round_trip(docs: DataFrame, ranks: str) -> DataFrame:
    """Encode each whole text and decode its ids: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokens(ranks, False, False)
        words = [str(i) for i in range(len(t.names))]
        for b in batches:
            rows = []
            for doc, ids in zip(b["doc_id"], t.encode(b["text"].tolist()), strict=True):
                ids = ids.tolist()
                rows.append((doc, len(ids), hashlib.sha256(" ".join(map(words.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(decode(t.names, ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs).mapInPandas(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
