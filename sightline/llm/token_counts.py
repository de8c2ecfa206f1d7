"""Token counts by a tokenizer compiled to a deterministic transducer.

The transducer reads the bytes of a word, the last of them marked.  Byte-pair
encoding of a prefix is known from the last token of each shorter prefix: the
token that ends at a byte is the only one that begins where a token t ends and
that t does not merge with.  So a state holds, for each suffix of the input
that begins some token, the place in the trie of tokens, the token that ends
before it, and how many tokens fewer are there.  A transition is annotated with
the change of the token count; reading a marked byte leads back to the start.
States and transitions are made when first met and then looked up.

A batch of texts is one stream of bytes, cut into chunks of equal length that
run side by side.  A chunk in which a word ends has a constant state map.  The map
of any other is made lazily, for the start state and for every state that the map
of the chunk before it leads to, until no new ones come up; runs from different
states soon fall together.  Then maps are composed by a parallel prefix scan: in
each step what has been reached is carried twice as many chunks on.  A chunk that
is entered from the scan's state gets its count, and the head of a chunk, up to the
first end of a word, is run from there.  Streams are taken in blocks, and the
automaton's memory is emptied between blocks when it is full, so that it is bounded
for texts of any kind and length.

Nulls and empty texts have no tokens.  Special strings of the vocabulary inside a
text count as one token each, as the library's default has it.  Very long texts are
counted whole, also as one word.  Repeated rows count alike, ties don't arise; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces as P
from .common import documents, lean
from .tokens import lower_nfc

CHUNK = 96
#: Characters of a batch, symbols of a block, and states beyond which the memory of the automaton is emptied between blocks.
BATCH, BLOCK, MOST_STATES = 1_000_000, 96 << 12, 150_000
MARK = 256  # added to the last byte of a word
#: A part of a state is node << 40, token before + 1 << 20, and the difference of counts + ZERO.
ZERO, LOW = 1 << 19, (1 << 40) - 1


class Transducer:
    """The automaton of one vocabulary."""

    def __init__(self, path: str):
        merges, names = P.merges_of(path)
        pairs = merges.pairs
        self.rank = {(int(a), int(b)): int(r) for a, b, r, _ in pairs}
        birth: dict[int, tuple[int, int, int]] = {}
        for a, b, r, new in pairs.tolist():
            birth.setdefault(new, (r, a, b))
        self.birth = birth
        single = {int(t): (b,) for b, t in enumerate(merges.first) if t >= 0} | {int(t): (b + MARK,) for b, t in enumerate(merges.last) if t >= 0}
        symbols = dict(single)
        for a, b, _, new in pairs.tolist():
            if new not in symbols and a in symbols and b in symbols:
                symbols[new] = symbols[a] + symbols[b]
        # The trie of tokens: children by (node, symbol), and the token that ends at a node.
        self.child: dict[int, int] = {}
        self.token = [-1]
        for t, s in symbols.items():
            node = 0
            for c in s:
                k = node << 10 | c
                if k not in self.child:
                    self.child[k] = len(self.token)
                    self.token.append(-1)
                node = self.child[k]
            self.token[node] = t
        self.joined: dict[tuple[int, int], bool] = {}
        self.spine = {0: lru_cache(1 << 17)(lambda t: self._spine(t, 1)), 1: lru_cache(1 << 17)(lambda t: self._spine(t, 0))}
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.content: list[tuple] = []
        self.map, self.next, self.change, self.n = P.IntMap(20), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), 0
        self._state((ZERO,))

    def _state(self, content: tuple) -> int:
        k = self.states.get(content)
        if k is None:
            k = self.states[content] = len(self.content)
            self.content.append(content)
        return k

    def _spine(self, t: int, side: int) -> list[tuple[int, int, int]]:
        """Parts of t at its left (side 0) or right (1) edge as merging goes on: (part, rank at which it arises, rank at which it is merged further)."""
        out, ends = [], P.NONE
        while True:
            b = self.birth.get(t)
            out.append((t, -1 if b is None else b[0], ends))
            if b is None:
                return out
            ends, t = b[0], b[1 + side]

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether token b right behind token a is how merging leaves them."""
        known = self.joined.get((a, b))
        if known is None:
            known = True
            for x, x_born, x_ends in self.spine[0](a):
                for y, y_born, y_ends in self.spine[1](b):
                    r = self.rank.get((x, y))
                    if r is not None and r < x_ends and r <= y_ends and max(r, y_born) < x_ends and max(r, x_born) <= y_ends:
                        known = False
                        break
                if not known:
                    break
            if len(self.joined) > 2_000_000:
                self.joined.clear()
            self.joined[a, b] = known
        return known

    def _make(self, state: int, symbol: int) -> tuple[int, int]:
        """Next state and change of the count."""
        grown, found, change = [], -1, 0
        child, token = self.child, self.token
        for part in self.content[state]:
            n = child.get(part >> 40 << 10 | symbol)
            if n is None:
                continue
            part &= LOW
            grown.append(n << 40 | part)
            if found < 0:
                t = token[n]
                if t >= 0:
                    before = (part >> 20) - 1
                    if before < 0 or self.stays_apart(before, t):
                        found, change = t, (part & 0xFFFFF) - ZERO + 1
        if found < 0:
            raise ValueError("a byte is not in the vocabulary")
        if symbol >= MARK:
            return 0, change
        return self._state((*(part - change for part in grown), (found + 1) << 20 | ZERO)), change

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and changes of the count."""
        keys = (state.astype(np.uint64) << np.uint64(9)) + symbol.astype(np.uint64) + np.uint64(1)
        rows = self.map.get(keys)
        missing = rows < 0
        if missing.any():
            new = np.unique(keys[missing])
            made = [self._make((k - 1) >> 9, (k - 1) & 511) for k in new.tolist()]
            if (self.map.n + len(new)) > 0.6 * len(self.map.keys):
                grown, old = P.IntMap(int(3 * (self.map.n + len(new))).bit_length()), np.flatnonzero(self.map.keys)
                grown.add(self.map.keys[old], self.map.rows[old])
                self.map = grown
            while self.n + len(new) > len(self.next):
                self.next, self.change = (np.concatenate([x, np.zeros_like(x)]) for x in (self.next, self.change))
            self.next[self.n : self.n + len(new)], self.change[self.n : self.n + len(new)] = zip(*made, strict=True)
            self.map.add(new, np.arange(self.n, self.n + len(new), dtype=np.int32))
            self.n += len(new)
            rows = self.map.get(keys)
        return self.next[rows], self.change[rows]

    def through(self, state: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States behind columns of symbols entered from `state`, and their changes of the count in all."""
        total = np.zeros(len(state), np.int64)
        for row in columns:
            state, change = self.step(state, row)
            total += change
        return state, total

    def scan(self, s: np.ndarray, free: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and change of the count of each chunk in `free` (no word ends in them).

        before: the exit state of each chunk's predecessor, if that is not in `free`.
        """
        follows = np.append(False, free[1:] == free[:-1] + 1)  # the predecessor is free as well
        # Nodes of the maps: (place in free, entry state) with exit state and count.
        where, entry = np.arange(len(free)), np.zeros(len(free), np.int64)
        roots = np.flatnonzero(~follows)
        where, entry = np.append(where, roots), np.append(entry, before[free[roots]])
        new = np.unique(where << 32 | entry)
        known = out = total = np.zeros(0, np.int64)
        while len(new):
            exit_, change = self.through((new & 0xFFFFFFFF).astype(np.int32), s[:, free[new >> 32]])
            known, out, total = np.append(known, new), np.append(out, exit_.astype(np.int64)), np.append(total, change)
            order = np.argsort(known)
            known, out, total = known[order], out[order], total[order]
            on = (known >> 32) + 1
            on, state = on[on < len(free)], out[on < len(free)]
            asked = np.unique((on << 32 | state)[follows[on]])
            new = np.setdiff1d(asked, known, assume_unique=True)
        # What each node leads to (itself where the run of free chunks ends), then twice as far in each step.
        on = (known >> 32) + 1
        leads = np.arange(len(known))
        some = np.flatnonzero((on < len(free)) & follows[np.minimum(on, len(free) - 1)])
        leads[some] = np.searchsorted(known, on[some] << 32 | out[some])
        reached = np.zeros(len(known), bool)
        reached[np.searchsorted(known, roots << 32 | before[free[roots]])] = True
        for _ in range(len(free).bit_length()):
            reached[leads[reached]] = True
            leads = leads[leads]
        at = np.flatnonzero(reached)  # one node for each chunk, in order
        return out[at], total[at]

    def changes(self, symbols: np.ndarray, entry: int = 0) -> tuple[np.ndarray, int]:
        """Change of the count at the symbols of a stream entered in a state, right in sum at each end of a word; and the state behind it if it is of whole chunks."""
        n, lanes = len(symbols), -(-len(symbols) // CHUNK)
        s = np.full(lanes * CHUNK, MARK, np.int32)  # the filling is a run of one-byte words
        s[:n] = symbols
        s = s.reshape(lanes, CHUNK).T.copy()
        out = np.zeros((CHUNK, lanes), np.int32)
        ends = s >= MARK
        constant = ends.any(0)
        head = np.where(constant, ends.argmax(0), CHUNK)
        # Bodies: what follows the first end of a word, from the start state.
        state = np.zeros(lanes, np.int32)
        order = np.argsort(head, kind="stable")
        begun = np.searchsorted(head[order], np.arange(CHUNK), side="left")
        for t in range(1, CHUNK):
            i = order[: begun[t]]  # head < t
            if len(i):
                state[i], out[t, i] = self.step(state[i], s[t, i])
        free = np.flatnonzero(~constant)
        if len(free):
            before = np.append(entry, state[:-1]).astype(np.int64)
            state[free], out[0, free] = self.scan(s, free, before)
        # Heads, from the entry states.
        i = np.flatnonzero(constant)
        q, t = np.append(np.int32(entry), state[:-1]).astype(np.int32)[i], 0
        while len(i):
            q, out[t, i] = self.step(q, s[t, i])
            on = head[i] > t
            i, q, t = i[on], q[on], t + 1
        return out.T.reshape(-1)[:n], int(state[-1])

    def blocks(self, symbols: np.ndarray) -> np.ndarray:
        """Changes of the count of a whole stream, block by block."""
        out, state = [], 0
        for at in range(0, len(symbols), BLOCK):
            if len(self.content) > MOST_STATES:
                content = self.content[state]
                self.clear()
                state = self._state(content)
            part, state = self.changes(symbols[at : at + BLOCK], state)
            out.append(part)
        return np.concatenate(out)


def stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words of the texts, the last of each word marked, and where each text ends in them."""
    cp, kinds, ends = P.code_points([lower_nfc(t) for t in texts])
    keep = (kinds != P.S) & (kinds != P.E)
    start = P.split_words(cp, kinds)
    last = np.zeros(len(cp), bool)
    last[np.append(start[1:], len(cp)) - 1] = True
    size = np.where(keep, 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000), 0)
    after = np.cumsum(size)
    words = cp[keep].tobytes().decode("utf-32-le").encode()
    symbols = np.frombuffer(words, np.uint8).astype(np.int32)
    symbols[after[last & keep] - 1] += MARK
    return symbols, after[ends]


class Counter:
    """Counts tokens of texts by word_bpe_49k-like vocabularies."""

    def __init__(self, path: str):
        import json

        self.transducer = Transducer(path)
        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.names = special
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def count(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        part: list[tuple[int, str]] = []
        held = 0
        for i, text in enumerate(texts):
            if any(name in text for name in self.names):
                bits = self.special.split(text)
                out[i] += len(bits) - 1
                text = "\n".join(bits)
            for t in P.cut(text, BATCH) if len(text) > BATCH else [text]:
                part.append((i, t))
                held += len(t)
                if held >= BATCH:
                    self._run(part, out)
                    part, held = [], 0
        self._run(part, out)
        return out

    def _run(self, part, out) -> None:
        if not part:
            return
        symbols, ends = stream([t for _, t in part])
        if not len(symbols):
            return
        total = np.append(0, np.cumsum(self.transducer.blocks(symbols), dtype=np.int64))[ends]
        np.add.at(out, [i for i, _ in part], np.diff(total, prepend=0))


@lru_cache(2)
def counter(path: str) -> Counter:
    """One per Python worker."""
    return Counter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text."""
    rows = documents(docs)
    rows = rows.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = counter(vocabulary).count(b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": n, "over_limit": n > limit})

    return rows.mapInPandas(lean(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
