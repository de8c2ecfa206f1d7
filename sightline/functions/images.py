"""Statistics of grey or colour pixels, as Arrow functions.

Pixels come as bytes, row by row, `channels` bytes each (Spark's image source
gives blue, green, red).  Bytes that don't fit the size give null.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Least texture, share of edge pixels and colour spread, and the thresholds of the edge detector.
LEAST_TEXTURE, LEAST_EDGES, LEAST_COLOUR, LOW, HIGH = 12.0, 0.05, 10.0, 50, 150
#: Fixed value: how a PNG file begins.
PNG = b"\x89PNG\r\n\x1a\n"
#: Pixels that are worked on at a time.
STRIP = 1 << 20


def pixels(data: bytes | None, h: int, w: int, channels: int) -> np.ndarray | None:
    if data is None or h * w * channels != len(data) or not len(data):
        return None
    return np.frombuffer(data, np.uint8).reshape(h, w, channels)


def grey(p: np.ndarray) -> np.ndarray:
    return p[:, :, 0].astype(np.float64) if p.shape[2] < 3 else p[:, :, :3] @ np.array([0.114, 0.587, 0.299])


def strips(p: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a picture, of about STRIP pixels: what is worked on as floating-point numbers at a time."""
    step = max(1, STRIP // p.shape[1])
    for lo in range(0, p.shape[0], step):
        yield lo, min(p.shape[0], lo + step)


def _thin(p: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of the gradient in some rows of a picture, and where it is largest across its direction."""
    h = p.shape[0]
    rows = np.clip(np.arange(lo - 2, hi + 2), 0, h - 1)  # beyond the border the outermost row goes on
    q = np.pad(grey(p[rows[0] : rows[-1] + 1])[rows - rows[0]], ((0, 0), (1, 1)), mode="edge")
    gx = (q[:-2, 2:] + 2 * q[1:-1, 2:] + q[2:, 2:]) - (q[:-2, :-2] + 2 * q[1:-1, :-2] + q[2:, :-2])
    gy = (q[2:, :-2] + 2 * q[2:, 1:-1] + q[2:, 2:]) - (q[:-2, :-2] + 2 * q[:-2, 1:-1] + q[:-2, 2:])
    size = np.abs(gx) + np.abs(gy)
    outside = np.arange(lo - 1, hi + 1)
    size[(outside < 0) | (outside >= h)] = 0
    m = np.pad(size, ((0, 0), (1, 1)))
    size, gx, gy = size[1:-1], gx[1:-1], gy[1:-1]
    turn = np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    thin = np.zeros(size.shape, bool)
    for k, (dy, dx) in enumerate([(0, 1), (1, 1), (1, 0), (1, -1)]):
        a = m[1 + dy : m.shape[0] - 1 + dy, 1 + dx : m.shape[1] - 1 + dx]
        b = m[1 - dy : m.shape[0] - 1 - dy, 1 - dx : m.shape[1] - 1 - dx]
        thin |= (turn == k) & (size > a) & (size >= b)
    return size, thin


def edges(p: np.ndarray, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Edge pixels: gradients thinned across their direction; weak ones count where they touch strong ones.

    Gradients are worked out in strips; of the whole picture only two marks a pixel are kept.
    """
    p = p if p.ndim == 3 else p[:, :, None]
    weak, strong = np.zeros(p.shape[:2], bool), np.zeros(p.shape[:2], bool)
    for lo, hi in strips(p):
        size, thin = _thin(p, lo, hi)
        weak[lo:hi], strong[lo:hi] = thin & (size > low), thin & (size > high)
    # From each strong pixel on to its weak neighbours, and from those that are new.
    y, x = np.nonzero(strong)
    while len(y):
        near = [(np.clip(y + dy, 0, p.shape[0] - 1), np.clip(x + dx, 0, p.shape[1] - 1)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        y, x = (np.concatenate(c) for c in zip(*near, strict=True))
        new = weak[y, x] & ~strong[y, x]
        at = np.unique(y[new] * p.shape[1] + x[new])
        y, x = at // p.shape[1], at % p.shape[1]
        strong[y, x] = True
    return strong & weak


def spread(p: np.ndarray) -> float:
    """Mean deviation of the channels."""
    n = p.shape[0] * p.shape[1]
    mean = sum(p[lo:hi].reshape(-1, p.shape[2]).sum(0, dtype=np.float64) for lo, hi in strips(p)) / n
    return float(np.sqrt(sum(((p[lo:hi].reshape(-1, p.shape[2]) - mean) ** 2).sum(0) for lo, hi in strips(p)) / n).mean())


def grey_spread(p: np.ndarray) -> float:
    """Deviation of the grey values."""
    n = p.shape[0] * p.shape[1]
    mean = sum(grey(p[lo:hi]).sum() for lo, hi in strips(p)) / n
    return float(np.sqrt(sum(((grey(p[lo:hi]) - mean) ** 2).sum() for lo, hi in strips(p)) / n))


def _statistic(f):
    @F.pandas_udf("double")
    def run(data: pd.Series, h: pd.Series, w: pd.Series, channels: pd.Series) -> pd.Series:
        found = (pixels(*x) for x in zip(data, h, w, channels, strict=True))
        return pd.Series([None if p is None else float(f(p)) for p in found], dtype="float64")

    return run


def png(data, h, w, channels):
    """A PNG file of 8-bit pixels with one channel or three (blue, green, red); null where bytes and size do not fit."""

    @F.pandas_udf("binary")
    def run(data: pd.Series, h: pd.Series, w: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([encode_png(pixels(*x)) for x in zip(data, h, w, channels, strict=True)], dtype=object)

    return run(data, h, w, channels)


def encode_png(p: np.ndarray | None) -> bytes | None:
    """A picture of one or three channels as a PNG file without filters."""
    if p is None or p.shape[2] not in (1, 3):
        return None
    h, w, c = p.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.zeros((h, 1 + w * c), np.uint8)  # each row after a mark for no filter
    rows[:, 1:] = p[:, :, ::-1].reshape(h, w * c)
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if c == 1 else 2, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def texture(data, h, w, channels):
    """Deviation of the grey values."""
    return _statistic(grey_spread)(data, h, w, channels)


def edge_share(data, h, w, channels):
    """Share of edge pixels."""
    return _statistic(lambda p: edges(p).mean())(data, h, w, channels)


def colour_spread(data, h, w, channels):
    """Mean deviation of the channels."""
    return _statistic(spread)(data, h, w, channels)
