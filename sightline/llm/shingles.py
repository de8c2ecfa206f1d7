"""Word shingles of whole texts, as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np

#: The bytes between words (space, and tab to carriage return).
BREAKS = [0x20, *range(0x09, 0x0E)]
_MIX = np.uint64(0xD6E8FEB86659FD93)
_is_break = np.zeros(256, bool)
_is_break[BREAKS] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_odd = int(np.random.default_rng(9).integers(1 << 62, 1 << 63)) | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _up_down(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 19)
        one = np.ones(1, np.uint64)
        _powers[0] = np.append(one, np.cumprod(np.full(n, _odd, np.uint64)))
        _powers[1] = np.append(one, np.cumprod(np.full(n, pow(_odd, -1, 1 << 64), np.uint64)))
    return _powers[0], _powers[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last byte (end) within the batch of each word (A-Z in lower case) of all texts, and how many words each text has."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    gap = _is_break[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(raw) and not gap[0]:
        edge = np.append(0, edge)
    first, last = edge[0::2], edge[1::2]
    up, down = _up_down(len(raw) + 1)
    x = (_lower[raw].astype(np.uint64) + np.uint64(0x51ED27)) * _MIX
    x ^= x >> np.uint64(32)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(x * up[: len(raw)], out=total[1:])
    h = (total[last] - total[first]) * down[first]
    h ^= h >> np.uint64(31)
    h *= _MIX
    return h, first, last, np.diff(np.searchsorted(first, ends), prepend=0)


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each `size` words in a row (across texts too: the caller leaves those out)."""
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (h[k : len(h) - size + 1 + k] ^ (h[k : len(h) - size + 1 + k] >> np.uint64(29)))
    out ^= out >> np.uint64(32)
    return out * _MIX


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words the whole sequence is the one shingle, without words there is none."""
    h, _, _, words = word_hashes(texts)
    s = shingle_hashes(h, size)
    out, at = [], 0
    for n in words.tolist():
        if n >= size:
            out.append(np.unique(s[at : at + n - size + 1]))
        elif n:
            short = np.array([n], np.uint64)
            for k in range(at, at + n):
                short = short * np.uint64(0xBF58476D1CE4E5B9) + h[k]
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def helpings(texts: list, size: int = 300_000):
    """Index ranges of a batch, each of about `size` bytes."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= size or i == len(texts) - 1:
            yield at, i + 1
            at, held = i + 1, 0
