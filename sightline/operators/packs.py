"""Nearest rows where nothing can be ruled out: packs of queries meet packs of rows.

Queries and rows are packed where they lie, without a shuffle, and kept once in the
shared folder.  Every task then holds one pack of queries against the packs of some
tens of megabytes of rows, as a plain cross join gives them, and returns the k best
that it found: what is shuffled are those hits, no vectors.

Distances are estimated in single precision; what comes within the error of the k-th
best is worked out from the differences in double precision.  So equal vectors are
at equal distances, and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of packs of rows that one task goes through, about; pairs that are worked out at once; and queries likewise.
HELD, PAIRS, STEP = 64 << 20, 1 << 16, 256
HITS = "query_id long, vec_id long, d2 double"


def _pack(ids: np.ndarray, v: np.ndarray, copies: int | None) -> pd.DataFrame:
    """One row for ids and vectors; of equal vectors the `copies` smallest ids."""
    if copies:
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], np.ascontiguousarray(v[order])
        same = np.unique(v.view(f"V{v.shape[1] * 8}").ravel(), return_inverse=True)[1].ravel()
        by = np.argsort(same, kind="stable")
        turn = np.empty(len(by), np.int64)
        turn[by] = np.arange(len(by)) - np.searchsorted(same[by], same[by], side="left")
        ids, v = ids[turn < copies], v[turn < copies]
    with np.errstate(over="ignore"):
        half = v.astype(np.float32)
    exact = bool((half == v).all())  # vectors stored in single precision take half the room
    return pd.DataFrame({"ids": [ids.astype(np.int64).tobytes()], "vectors": [(half if exact else v).tobytes()], "single": [exact]})


def packed(rows: DataFrame, n: int, id_: str, size: int, copies: int | None = None) -> DataFrame:
    """Rows(id_, embedding) in packs of at most `size`, kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        have = 0
        for b in batches:
            for at in range(0, len(b), size):
                part = b.iloc[at : at + size]
                if have + len(part) > size:
                    yield _pack(*map(np.concatenate, zip(*held, strict=True)), copies)
                    held, have = [], 0
                held.append((part[id_].to_numpy(), np.array([np.asarray(x, np.float64) for x in part["embedding"]], np.float64)))
                have += len(part)
        if held:
            yield _pack(*map(np.concatenate, zip(*held, strict=True)), copies)

    out = rows.select(id_, "embedding").coalesce(max(1, -(-n // size))).mapInPandas(run, "ids binary, vectors binary, single boolean")
    # Tasks read packs over and over; a shared folder, where there is one, keeps them.
    return out.checkpoint() if rows.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else out.persist()


def _open(ids: bytes, vectors: bytes, single: bool) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(vectors, np.float32 if single else np.float64).reshape(len(i), -1)


class Best:
    """The k best rows so far of a pack of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, leave_out_self: bool):
        self.ids, self.k, self.leave_out_self = ids, k, leave_out_self
        self.v = vectors.astype(np.float64)
        self.half = np.hstack([vectors, np.ones((len(ids), 1))]).astype(np.float32)
        self.norm = (self.v * self.v).sum(1)
        self.d2 = np.full((len(ids), k), np.inf)
        self.hit = np.zeros((len(ids), k), np.int64)

    def see(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        g = vectors.astype(np.float64)
        norm = (g * g).sum(1)
        half = np.hstack([-2 * g, norm[:, None]]).astype(np.float32).T
        # What rounding may take from or add to an estimate.
        error = (g.shape[1] + 16) * 2.0**-22 * (self.norm + np.max(norm[np.isfinite(norm)], initial=0.0))
        for at in range(0, len(self.ids), STEP):
            part = slice(at, at + STEP)
            about = self.half[part] @ half  # without the query's own norm
            limit = self.d2[part, -1] - self.norm[part] + error[part]
            open_ = np.flatnonzero(np.isinf(limit))
            most = self.k + self.leave_out_self  # one of them may be the query itself
            if len(open_) and most < len(ids):
                limit[open_] = np.partition(about[open_], most - 1, axis=1)[:, most - 1] + 2 * error[part][open_]
            row, col = np.divmod(np.flatnonzero(about <= np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None]), len(ids))
            if self.leave_out_self:
                other = self.ids[part][row] != ids[col]
                row, col = row[other], col[other]
            for k in range(0, len(row), PAIRS):
                self._take(row[k : k + PAIRS] + at, col[k : k + PAIRS], ids, g)

    def _take(self, row: np.ndarray, col: np.ndarray, ids: np.ndarray, g: np.ndarray) -> None:
        away = self.v[row] - g[col]
        dist = (away * away).sum(1)
        near = dist <= self.d2[row, -1]
        near &= dist < np.inf
        row, col, dist = row[near], col[near], dist[near]
        touched = np.unique(row)
        rows = np.concatenate([np.repeat(touched, self.k), row])
        hits, dist = np.concatenate([self.hit[touched].ravel(), ids[col]]), np.concatenate([self.d2[touched].ravel(), dist])
        order = np.lexsort((hits, dist, rows))
        rows, hits, dist = rows[order], hits[order], dist[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        keep = place < self.k
        self.hit[rows[keep], place[keep]], self.d2[rows[keep], place[keep]] = hits[keep], dist[keep]

    def hits(self) -> pd.DataFrame:
        row, col = np.nonzero(self.d2 < np.inf)
        return pd.DataFrame({"query_id": self.ids[row], "vec_id": self.hit[row, col], "d2": self.d2[row, col]})


def nearest(queries: DataFrame, asked: int, gallery: DataFrame, rows: int, wide: int, k: int, size: int, leave_out_self: bool) -> DataFrame:
    """query_id, vec_id and d2 of the k nearest rows, or more, of each query; `wide`: numbers of a vector, `size`: vectors of a pack (of queries half as many)."""
    q = packed(queries, asked, "query_id", max(1, size // 2)).select(*(F.col(c).alias("q_" + c) for c in ("ids", "vectors", "single")))
    g = packed(gallery, rows, "vec_id", size, k + 1).coalesce(max(1, -(-rows * wide * 4 // HELD)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, best = None, None
        for b in batches:
            for r in b.itertuples(index=False):
                if r.q_ids != asked:
                    if best:
                        yield best.hits()
                    asked, best = r.q_ids, Best(*_open(r.q_ids, r.q_vectors, r.q_single), k, leave_out_self)
                best.see(*_open(r.ids, r.vectors, r.single))
        if best:
            yield best.hits()

    # A plain product: nothing is sent to every task, and each task has few packs of rows.
    return q.crossJoin(g.hint("shuffle_replicate_nl")).mapInPandas(run, HITS)
