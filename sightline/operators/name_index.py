"""An inverted index over a list of names that bounds fuzzy scores from above.

For each character it has the names that hold it and how often, for each word the
names that have it.  From these, a text's common characters with every name come
out as sums over postings; they bound the longest common subsequence, and so, with
lengths and numbers of words, each of the scores.  The best name is searched in
the order of the bounds until no bound reaches the best score so far: the result is
that of scoring every name, ties included.

Where names are much alike, as numbered ones are, the bounds leave nearly all of
them.  The plain ratio therefore goes through all names side by side (NameTree).
"""

from __future__ import annotations

from collections import Counter

import numpy as np

from ..functions import similarity as S

#: Names scored before the first look at the bounds of the rest; what rounding may add to a score.
FIRST, ROUNDING = 8, 1e-9
#: Longest text that NameTree takes, and pairs that it holds at once, about.
WORD, PAIRS = 64, 1 << 16


class Shape:
    """Lengths of a text that the bounds need, as numbers or arrays of them."""

    __slots__ = ("length", "blanks", "words", "sorted", "distinct", "unique")

    def __init__(self, texts: list[str]):
        words = [t.split() for t in texts]
        sets = [set(w) for w in words]
        self.length = np.array([len(t) for t in texts], np.int64)
        self.blanks = self.length - np.array([sum(map(len, w)) for w in words], np.int64)
        self.words = np.array([len(w) for w in words], np.int64)
        self.unique = np.array([len(s) for s in sets], np.int64)
        self.sorted = np.array([len(" ".join(w)) for w in words], np.int64)
        self.distinct = np.array([len(" ".join(s)) for s in sets], np.int64)


def _ratio(common: np.ndarray, a, b) -> np.ndarray:
    """Bound of the ratio of texts of lengths a and b."""
    common = np.minimum(common, np.minimum(a, b))
    return np.where(a + b > 0, 200.0 * common / np.maximum(a + b, 1), 100.0)


def _partial(common: np.ndarray, a, b) -> np.ndarray:
    """Bound of the partial ratio: a stretch is at least as long as what it has in common."""
    short = np.minimum(a, b)
    common = np.minimum(common, short)
    return np.where(short > 0, 200.0 * common / np.maximum(short + common, 1), np.where(np.maximum(a, b) > 0, 0.0, 100.0))


class NameTree:
    """Names by their beginnings, so that what they have in common is compared with a text once.

    The longest common subsequence is found by bits over the text, as in
    similarity.lcs, for many texts and all beginnings of one length at a time.
    """

    def __init__(self, names: list[str]):
        self.n = len(names)
        self.length = np.array([len(y) for y in names], np.int64)
        self.place = {c: i for i, c in enumerate(sorted(set().union(*names)), 1)}  # 0: past the end
        order = sorted(range(self.n), key=names.__getitem__)
        self.leaf = np.empty(self.n, np.int64)  # by name: its place in order
        self.leaf[order] = np.arange(self.n)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # the beginning without the last letter, and that letter
        new, node = np.zeros(self.n, bool), np.zeros(self.n, np.int32)
        new[:1] = True
        for k in range(int(self.length.max(initial=0))):
            letter = np.array([self.place[names[i][k]] if k < len(names[i]) else 0 for i in order], np.int32)
            new[1:] |= letter[1:] != letter[:-1]
            self.levels.append((node[new], letter[new]))
            node = (np.cumsum(new) - 1).astype(np.int32)
        self.last = node

    def ratios(self, texts: list[str]) -> np.ndarray:
        """The ratio of each text, of WORD letters at most, with each name."""
        masks = np.zeros((len(texts), len(self.place) + 1), np.uint64)
        for i, t in enumerate(texts):
            for k, c in enumerate(t):
                if c in self.place:
                    masks[i, self.place[c]] |= np.uint64(1 << k)
        v = np.full((len(texts), 1), np.iinfo(np.uint64).max, np.uint64)
        for parent, letter in self.levels:
            v = v.take(parent, axis=1)
            u = v & masks.take(letter, axis=1)
            v = (v + u) | (v - u)
        length = np.array([len(t) for t in texts], np.int64)[:, None]
        full = np.array([[(1 << len(t)) - 1] for t in texts], np.uint64)
        common = length - np.bitwise_count(v & full).take(self.last, axis=1).take(self.leaf, axis=1)
        both = length + self.length
        return np.where(both > 0, 200.0 * common / np.maximum(both, 1), 100.0)


class NameIndex:
    """Names in the order in which ties are decided, for one scorer."""

    def __init__(self, names: list[str], scorer: str):
        self.names, self.scorer, self.score = names, scorer, S.SCORERS[scorer]
        texts = [self._plain(n) for n in names]
        self.shape = Shape(texts)
        letters: dict[str, list[tuple[int, int]]] = {}
        words: dict[str, list[int]] = {}
        for i, t in enumerate(texts):
            for c, n in Counter(t).items():
                if not c.isspace():
                    letters.setdefault(c, []).append((i, n))
            for w in set(t.split()):
                words.setdefault(w, []).append(i)
        self.letters = {c: tuple(np.array(x, np.int64) for x in zip(*p, strict=True)) for c, p in letters.items()}
        self.words = {w: np.array(p, np.int64) for w, p in words.items()}
        self.starts = [np.array([t[k : k + 1] for t in texts], "U1") for k in range(4)]
        self.scored = 0
        self.tree: NameTree | None = None

    def _plain(self, text: str) -> str:
        return S.smart_form(text) if self.scorer == "smart_score" else text

    def bounds(self, text: str) -> np.ndarray:
        """What the score with each name cannot exceed."""
        text = self._plain(text)
        letters = np.zeros(len(self.names), np.int64)
        for c, n in Counter(text).items():
            if c in self.letters:
                at, have = self.letters[c]
                letters[at] += np.minimum(have, n)
        shared = np.zeros(len(self.names), bool)
        for w in set(text.split()):
            if w in self.words:
                shared[self.words[w]] = True
        q, g = Shape([text]), self.shape
        raw = letters + np.minimum(q.blanks, g.blanks)
        many = letters + np.maximum(np.minimum(q.words, g.words) - 1, 0)
        few = letters + np.maximum(np.minimum(q.unique, g.unique) - 1, 0)

        def whole():
            return _ratio(raw, q.length, g.length)

        def by_word():
            return _ratio(many, q.sorted, g.sorted)

        def by_set():
            return np.where((q.words == 0) | (g.words == 0), 0.0, np.where(shared, 100.0, _ratio(few, q.distinct, g.distinct)))

        def part():
            return _partial(raw, q.length, g.length)

        def part_by_word():
            return np.where(shared, 100.0, np.maximum(_partial(many, q.sorted, g.sorted), _partial(few, q.distinct, g.distinct)))

        def weighted():
            long, short = np.maximum(q.length, g.length), np.minimum(q.length, g.length)
            scale = np.where(long <= 8 * short, 0.9, 0.6)
            alike = np.maximum(whole(), 0.95 * np.maximum(by_word(), by_set()))
            unlike = np.maximum(np.maximum(whole(), scale * part()), 0.95 * scale * part_by_word())
            return np.where(short == 0, 0.0, np.where(long < 1.5 * short, alike, unlike))

        def winkler():
            both = np.minimum(raw, np.minimum(q.length, g.length))
            jaro = np.where((both > 0) | (q.length == g.length), (both / np.maximum(q.length, 1) + both / np.maximum(g.length, 1) + 1) / 3, 0.0)
            same, prefix = np.ones(len(self.names), bool), np.zeros(len(self.names))
            for k in range(4):
                same = same & (self.starts[k] == text[k : k + 1]) & (len(text) > k)
                prefix += same
            jaro = np.where((q.length == 0) & (g.length == 0), 1.0, jaro)
            return np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)

        def smart():
            short = np.maximum(q.length, g.length) <= 6
            out = np.where((q.words > 1) & (g.words > 1), weighted(), np.where(short, 100 * winkler(), part()))
            return np.where((q.length == 0) | (g.length == 0), 0.0, out)

        kinds = {"ratio": whole, "partial_ratio": part, "token_sort_ratio": by_word, "token_set_ratio": by_set, "wratio": weighted, "jaro_winkler": winkler, "smart_score": smart}
        return kinds[self.scorer]() + ROUNDING

    def best(self, text: str) -> tuple[float, int] | None:
        """The best score and the first name that has it; None without names."""
        if not self.names:
            return None
        bound = self.bounds(text)
        best, seen = (-1.0, 0), np.zeros(len(bound), bool)

        def look(order: np.ndarray) -> None:
            nonlocal best
            for i in order[np.lexsort((order, -bound[order]))].tolist():
                if bound[i] < best[0]:
                    break
                seen[i] = True
                best = max(best, (self.score(text, self.names[i]), -i))
                self.scored += 1

        k = min(FIRST, len(bound))
        look(np.argpartition(-bound, k - 1)[:k])
        look(np.flatnonzero((bound >= best[0]) & ~seen))
        return best[0], -best[1]

    def best_of_each(self, texts: list[str]) -> list[tuple[float, int] | None]:
        """`best` of many texts."""
        if self.scorer != "ratio" or not self.names:
            return [self.best(x) for x in texts]
        self.tree = self.tree or NameTree(self.names)
        short = [i for i, x in enumerate(texts) if len(x) <= WORD]
        found: dict[int, tuple[float, int]] = {}
        step = max(1, PAIRS // len(self.names))
        for at in range(0, len(short), step):
            part = short[at : at + step]
            scores = self.tree.ratios([texts[i] for i in part])
            top = scores.argmax(1)  # the first of equal ones
            found |= {i: (float(row[k]), int(k)) for i, row, k in zip(part, scores, top, strict=True)}
        return [found[i] if i in found else self.best(x) for i, x in enumerate(texts)]
