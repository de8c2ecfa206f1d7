"""Vectorised splitting of texts into tokenizer pieces, and byte-pair merging.

Texts are held as arrays of code points.  `split_*` find piece boundaries of a
whole batch with array operations; `PieceEncoder` maps each distinct piece to
its token ids once and looks the rest up in an open-addressing table.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import regex

L, N, S, O, E = 0, 1, 2, 3, 4  # letter, number, white space, other, end of text

#: The code points with Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: The contraction endings in the public split patterns.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of each code point."""
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    out = np.full(0x110000, O, np.uint8)
    for kind, pattern in ((L, r"\p{L}"), (N, r"\p{N}")):
        found = np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)
        out[found] = kind
    out[WHITE_SPACE] = S
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by one end mark; the class of each; the position of each mark."""
    flat = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kinds = char_classes()[flat]
    kinds[ends] = E
    return flat, kinds, ends


def _contractions(cp: np.ndarray, kinds: np.ndarray, start: np.ndarray, at: np.ndarray) -> None:
    """Apply contraction pieces at the apostrophes `at`, in place."""
    if not len(at):
        return
    pad = np.append(cp, [0, 0, 0])
    a, b = pad[at + 1], pad[at + 2]
    ends = np.append(kinds, [E, E, E])
    size = np.zeros(len(at), np.int64)
    for c in CONTRACTIONS:
        hit = (a == ord(c[0])) & (ends[at + 1] == L)
        if len(c) == 2:
            hit &= (b == ord(c[1])) & (ends[at + 2] == L)
        size[hit] = len(c) + 1
    at, size = at[size > 0], size[size > 0]
    start[at + 1] = False
    start[at[size == 3] + 2] = False
    start[at + size] = True


def split_spaced(cp: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Starts of pieces where a space joins the next piece; an end mark is a piece of its own.

    The pattern is that of byte_bpe_50k: a run of white space before other
    text leaves its last character to what follows.
    """
    n = len(cp)
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=start[1:])
    start |= kinds == E
    follows = np.zeros(n, bool)  # the last white space before something that is not the end
    follows[:-1] = (kinds[:-1] == S) & (kinds[1:] < E) & (kinds[1:] != S)
    start |= follows
    glue = follows & (cp == 32)
    quote = np.flatnonzero((cp == 39) & start)
    quote = quote[~np.append(False, glue)[quote]] if len(quote) else quote
    start[1:][glue[:-1]] = False
    _contractions(cp, kinds, start, quote)
    return np.flatnonzero(start)


def split_words(cp: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Starts of pieces for word_bpe_49k; runs of white space and end marks are pieces to be dropped."""
    start = np.empty(len(cp), bool)
    start[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=start[1:])
    start |= (kinds == E) | (kinds == N)
    _contractions(cp, kinds, start, np.flatnonzero((cp == 39) & start))
    return np.flatnonzero(start)


_CUT = regex.compile(r"(?<=[^\s]) (?=[A-Za-z])")


def cut(text: str, size: int) -> list[str]:
    """A text in parts of about `size` that can be tokenised one by one: before a space between a non-space and a letter a piece always begins."""
    out, at = [], 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


class IntMap:
    """Open-addressing table from uint64 keys (not 0) to rows, with array lookups."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.rows, self.n = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.rows[slot], -1)
        left = np.flatnonzero((found != keys) & (found != 0))
        while len(left):
            slot_ = (slot[left] + 1) & self.mask
            slot[left] = slot_
            found, want = self.keys[slot_], keys[left]
            hit = found == want
            out[left[hit]] = self.rows[slot_[hit]]
            left = left[~hit & (found != 0)]
        return out

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Insert distinct keys that are not there yet."""
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            s = slot[left]
            free = self.keys[s] == 0
            self.keys[s[free]] = keys[left[free]]  # of several for one slot, one stays
            won = np.zeros(len(left), bool)
            won[free] = self.keys[s[free]] == keys[left[free]]
            self.rows[s[won]] = rows[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & self.mask
        self.n += len(keys)


LONG_PIECE = 1024  #: bytes of a piece beyond which it is merged by itself
NONE = 1 << 17  #: the rank of a pair that does not merge, above all ranks


class Merges:
    """Pair ranks of a vocabulary and merging by segment trees.

    `pairs`: (left id, right id, rank, new id).  `first`: ids of the 256 bytes;
    `last`: their ids at the end of a piece.
    """

    def __init__(self, pairs: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.table = IntMap(max(12, int(len(pairs) * 3).bit_length()))
        self.table.add(self._key(pairs[:, 0], pairs[:, 1]), np.arange(len(pairs), dtype=np.int32))
        self.rank = np.append(pairs[:, 2], NONE).astype(np.int32)
        by = np.argsort(pairs[:, 2], kind="stable")
        self.new_of_rank = np.zeros(int(pairs[:, 2].max()) + 1, np.int32)
        self.new_of_rank[pairs[by, 2]] = pairs[by, 3]
        self.first, self.last, self.pairs, self.by_pair = first, last, pairs, None

    @staticmethod
    def _key(a, b):
        return (a.astype(np.uint64) << np.uint64(20)) + b.astype(np.uint64) + np.uint64(1)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it does not merge; negative ids never merge."""
        out = np.full(len(a), NONE, np.int32)
        ok = np.flatnonzero((a >= 0) & (b >= 0))
        out[ok] = self.rank[self.table.get(self._key(a[ok], b[ok]))]
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of all pieces in one array, and where each piece's begin and how many they are; pieces of like size are merged side by side."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat, begin, count, used = [], np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), 0
        width = 1 << np.maximum(1, np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64))
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            if w > LONG_PIECE:  # few and long: one tree at a time, point by point
                for i in rows.tolist():
                    ids = self._merge_long(pieces[i])
                    flat.append(ids)
                    count[i], begin[i] = len(ids), used
                    used += len(ids)
                continue
            step = max(1, (1 << 17) // int(w))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                ids, n = self._merge([pieces[i] for i in part], int(w))
                flat.append(ids)
                count[part], begin[part] = n, used + np.cumsum(n) - n
                used += len(ids)
        return np.concatenate([np.zeros(0, np.int32), *flat]), begin, count

    def _merge(self, pieces: list[bytes], w: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        kind = np.int32 if w <= 4096 else np.int64
        sym = np.full((n, w + 1), -1, np.int32)  # column w: what stands behind the last byte
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        at = np.arange(w) < sizes[:, None]
        sym[:, :w][at] = self.first[raw]
        sym[np.arange(n), sizes - 1] = self.last[raw[np.cumsum(sizes) - 1]]
        after = np.minimum(np.arange(1, w + 2, dtype=np.int32)[None, :].repeat(n, 0), w)
        before = np.arange(-1, w, dtype=np.int32)[None, :].repeat(n, 0)
        # Leaf i of a tree: rank of the pair that begins at byte i, with i below it, so that the least is the leftmost.
        tree = np.full((n, 2 * w), NONE * w, kind)
        leaves = self.ranks(sym[:, :w].ravel(), sym[:, 1:].ravel()).reshape(n, w)
        tree[:, w:] = leaves.astype(kind) * w + np.arange(w, dtype=kind)
        k = w
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2
        rows = np.arange(n)
        while True:
            root = tree[rows, 1]
            rows = rows[root < NONE * w]
            if not len(rows):
                break
            root = tree[rows, 1]
            i = root % w
            j = after[rows, i]
            k = after[rows, j]
            sym[rows, i] = self.new_of_rank[root // w]
            sym[rows, j] = -1
            after[rows, i] = k
            before[rows, k] = i
            h = before[rows, i]
            self._point(tree, rows, j, np.full(len(rows), NONE, kind), w)
            self._point(tree, rows, i, self.ranks(sym[rows, i], sym[rows, k]).astype(kind), w)
            has = h >= 0
            if has.any():
                r, h, i = rows[has], h[has], i[has]
                self._point(tree, r, h, self.ranks(sym[r, h], sym[r, i]).astype(kind), w)
        live = sym[:, :w] >= 0
        return sym[:, :w][live], live.sum(1)

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same for one long piece, on lists."""
        n = len(piece)
        bits = (n - 1).bit_length()
        w = 1 << bits
        ids = self.first[np.frombuffer(piece, np.uint8)].astype(np.int64)
        ids[-1] = self.last[piece[-1]]
        leaves = np.full(w, NONE, np.int64)
        leaves[: n - 1] = self.ranks(ids[:-1], ids[1:])
        levels = [(leaves << bits) + np.arange(w)]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][0::2], levels[-1][1::2]))
        tree = [0, *np.concatenate(levels[::-1]).tolist()]
        if self.by_pair is None:
            self.by_pair = {int(a) << 20 | int(b): int(r) for a, b, r, _ in self.pairs}
        by_pair, new_of, none = self.by_pair, self.new_of_rank.tolist(), NONE << bits
        sym, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n))

        def point(leaf: int, value: int) -> None:
            k = leaf + w
            tree[k] = value
            k >>= 1
            while k:
                two = 2 * k
                least = tree[two] if tree[two] < tree[two + 1] else tree[two + 1]
                if tree[k] == least:
                    return
                tree[k] = least
                k >>= 1

        while tree[1] < none:
            i = tree[1] & (w - 1)
            j = after[i]
            k = after[j]
            sym[i] = new_of[tree[1] >> bits]
            sym[j] = -1
            after[i] = k
            if k < n:
                before[k] = i
            point(j, none + j)
            point(i, (by_pair.get(sym[i] << 20 | sym[k], NONE) << bits) + i if k < n else none + i)
            h = before[i]
            if h >= 0:
                point(h, (by_pair.get(sym[h] << 20 | sym[i], NONE) << bits) + h)
        out = np.array(sym, np.int32)
        return out[out >= 0]

    @staticmethod
    def _point(tree, rows, leaf, rank, w):
        """Set a leaf in each row's tree and mend the minima above it."""
        flat, base, k = tree.reshape(-1), rows * (2 * w), leaf.astype(np.int64) + w
        flat[base + k] = rank * w + leaf
        while k[0] > 1:
            k = k >> 1
            two = base + 2 * k
            flat[base + k] = np.minimum(flat[two], flat[two + 1])


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves, the rest for code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(4)
def merges_of(path: str) -> tuple[Merges, list[bytes]]:
    """Merges of a .tiktoken or tokenizers .json vocabulary, and the bytes of each id."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        pairs = [(ranks[t[:k]], ranks[t[k:]], r, r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        one = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        names = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            names[r] = t
        return Merges(np.array(pairs, np.int64), one, one), names
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, end, byte = model["vocab"], model["end_of_word_suffix"] or "", byte_alphabet()
    pairs = [(vocab[a], vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])]
    first, last = np.full(256, -1, np.int64), np.full(256, -1, np.int64)
    for c, b in byte.items():
        first[b], last[b] = vocab.get(c, -1), vocab.get(c + end, -1)
    names = [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        t = t[: -len(end)] if end and t.endswith(end) and t != end else t
        names[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
    return Merges(np.array(pairs, np.int64), first, last), names


class PieceEncoder:
    """Ids of pieces, each distinct piece merged once while it is remembered.

    The memory is emptied at `most` pieces, so it is bounded; that changes no
    result.  Pieces are told apart by a 64-bit hash of their code points.
    """

    def __init__(self, merges: Merges, most: int = 1_000_000):
        self.merges, self.most = merges, most
        rng = np.random.default_rng(20)
        self.odd = int(rng.integers(1 << 62, 1 << 63)) | 1
        self.inverse = pow(self.odd, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)
        self._clear()

    def _clear(self):
        self.table, self.pool = IntMap(21), np.zeros(1 << 20, np.uint16 if len(self.merges.new_of_rank) < 60000 else np.int32)
        self.used, self.at, self.size, self.rows = 0, np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), 0

    def _powers(self, n: int):
        if n > len(self.up):
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.full(n, self.odd, np.uint64))
                self.down = np.cumprod(np.full(n, self.inverse, np.uint64))

    def hashes(self, cp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A 64-bit polynomial hash of each span [a, b)."""
        self._powers(len(cp) + 1)
        with np.errstate(over="ignore"):
            x = (cp.astype(np.uint64) + np.uint64(0x51ED2701)) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            total = np.zeros(len(cp) + 1, np.uint64)
            np.cumsum(x * self.up[: len(cp)], out=total[1:])
            h = (total[b] - total[a]) * self.down[a]
            h ^= h >> np.uint64(29)
            return (h * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)

    def lookup(self, cp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row of each piece [a, b) of cp; `at` and `size` say where a row's ids lie in `pool`."""
        h = self.hashes(cp, a, b)
        row = self.table.get(h)
        missing = np.flatnonzero(row < 0)
        if len(missing):
            if self.rows > self.most:
                self._clear()
                missing = np.arange(len(h))
            new, where = np.unique(h[missing], return_index=True)
            where = missing[where]
            text = cp.tobytes().decode("utf-32-le")
            pieces = [text[i:j].encode() for i, j in zip(a[where].tolist(), b[where].tolist(), strict=True)]
            if len(new) + self.table.n > len(self.table.keys) * 0.6:
                grown = IntMap(int((len(new) + self.table.n) * 2).bit_length())
                old = np.flatnonzero(self.table.keys)
                grown.add(self.table.keys[old], self.table.rows[old])
                self.table = grown
            flat, begin, size = self.merges.encode(pieces)
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            while self.rows + len(new) > len(self.at):
                self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
            self.pool[self.used : self.used + len(flat)] = flat
            self.at[self.rows : self.rows + len(new)] = self.used + begin
            self.size[self.rows : self.rows + len(new)] = size
            self.table.add(new, np.arange(self.rows, self.rows + len(new), dtype=np.int32))
            self.used, self.rows = self.used + len(flat), self.rows + len(new)
            row = self.table.get(h)
        return row

    def ids(self, rows: np.ndarray) -> np.ndarray:
        """Ids of the pieces, one after another."""
        size = self.size[rows].astype(np.int64)
        ends = np.cumsum(size)
        if not len(ends):
            return self.pool[:0]
        return self.pool[np.arange(ends[-1]) + np.repeat(self.at[rows] - (ends - size), size)]
