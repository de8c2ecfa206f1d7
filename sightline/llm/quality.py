"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  Its own features and those of the lines before and
after it score the two labels, and a transition weight joins neighbouring
labels.  Forward-backward marginals, averaged with the lines' lengths as
weights, give the share of a document that is good; a logistic curve turns it
into a score.

Labels belong to documents, not lines.  Lines of good documents are taken as
good.  Lines of bad documents begin as bad; after each fit those that the model
finds good are relabelled, but the worst line of a bad document stays bad.

A null or empty text is one empty line and gets a score like any other.  A very
long text is scored whole.  Repeated rows get equal scores; rows are scored by
themselves, so there are no ties to decide.  An empty table gives an empty result.  Labels that are null, or rows without a text,
are not learned from; with no labels of both kinds every score is the share of
good ones (0.5 without any).  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches
from .pieces import L, N, O, S, char_classes, code_points

NAMES = ["upper", "digits", "symbols", "marks", "word_length", "repeats", "length", "empty", "twice", "distinct"]
#: Steps of the fit below which it stands still.
STILL = 4e-3
#: Characters handled in one array pass.
BATCH = 500_000
_upper: list[np.ndarray] = []


def _is_upper() -> np.ndarray:
    if not _upper:
        _upper.append(np.fromiter((chr(c).isupper() for c in range(0x110000)), bool, 0x110000) & (char_classes() == L))
    return _upper[0]


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line of all texts, the index of its text, and its length."""
    cp, kinds, ends = code_points(texts)
    stop = cp == 10
    stop[ends] = True
    last = np.flatnonzero(stop)
    first = np.append(0, last[:-1] + 1)
    text = np.searchsorted(ends, last)
    size = (last - first).astype(np.float64)

    def total(mask: np.ndarray) -> np.ndarray:
        c = np.append(0, np.cumsum(mask, dtype=np.int64))
        return (c[last] - c[first]).astype(np.float64)

    letters, some = total(kinds == L), np.maximum(size, 1)
    plain = np.isin(cp, np.frombuffer(".,;:'\"-()?!".encode("utf-32-le"), np.uint32))
    word = (kinds != S) & ~stop
    begin = np.flatnonzero(word & ~np.append(False, word[:-1]))
    finish = np.flatnonzero(word & ~np.append(word[1:], False)) + 1
    mixed = (cp.astype(np.uint64) + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    where = np.arange(len(cp), dtype=np.uint64)
    sums = np.append(np.uint64(0), np.cumsum(mixed, dtype=np.uint64))
    tilt = np.append(np.uint64(0), np.cumsum(mixed * where, dtype=np.uint64))

    def code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A hash of each span that knows the order of its characters."""
        plain = sums[b] - sums[a]
        return (tilt[b] - tilt[a] - plain * a.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) ^ plain

    h = code(begin, finish)
    line = np.searchsorted(last, begin)
    words = np.bincount(line, minlength=len(last)).astype(np.float64)
    same = np.append(False, (h[1:] == h[:-1]) & (line[1:] == line[:-1]))
    repeats = np.bincount(line, weights=same, minlength=len(last))
    order = np.lexsort((h, line))
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])) if len(h) else np.zeros(0, bool)
    distinct = np.bincount(line[order], weights=new, minlength=len(last))
    whole = code(first, last)
    order = np.lexsort((whole, text))
    equal = (whole[order][1:] == whole[order][:-1]) & (text[order][1:] == text[order][:-1]) & (size[order][1:] > 0)
    twice = np.zeros(len(last))
    twice[order[1:][equal]] = 1
    twice[order[:-1][equal]] = 1
    out = np.stack([
        total(_is_upper()[cp]) / np.maximum(letters, 1),
        np.sqrt(total(kinds == N) / some),
        np.sqrt(total((kinds == O) & ~plain & ~stop) / some),
        np.sqrt(total(plain & (kinds == O)) / some),
        np.minimum(size / np.maximum(words, 1), 30) / 10,
        repeats / np.maximum(words, 1),
        np.log1p(size) / 8,
        (size == 0) * 1.0,
        twice,
        distinct / np.maximum(words, 1),
    ], axis=1)
    return out, text, size


def with_neighbours(x: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Each line's features, those before and after it in its text, and whether there are such lines."""
    joined = np.append(False, text[1:] == text[:-1])
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[joined] = x[np.flatnonzero(joined) - 1]
    after[np.flatnonzero(joined) - 1] = x[joined]
    return np.hstack([x, before, after, joined[:, None], np.append(joined[1:], False)[:, None], np.ones((len(x), 1))])


def chains(unary: np.ndarray, text: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1 of each line, and the summed pair marginals (2 by 2).

    unary: score of label 1 against label 0; text: ascending.  Chains run side
    by side, longest first, so each step handles those still running.
    """
    n = len(unary)
    _, first, count = np.unique(text, return_index=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    running = np.searchsorted(-count, -np.arange(count[0]), side="left")  # chains with more than t lines
    u = np.stack([np.zeros(n), unary], 1)
    a = np.zeros((n, 2))
    b = np.zeros((n, 2))
    for t in range(count[0]):
        i = first[: running[t]] + t
        a[i] = u[i] if t == 0 else u[i] + np.logaddexp(a[i - 1, :1] + pair[0], a[i - 1, 1:] + pair[1])
    for t in range(count[0] - 2, -1, -1):
        i = first[: running[t + 1]] + t
        nxt = u[i + 1] + b[i + 1]
        b[i] = np.logaddexp(pair[:, 0] + nxt[:, :1], pair[:, 1] + nxt[:, 1:])
    both = a + b
    top = both.max(1, keepdims=True)
    log_z = top[:, 0] + np.log(np.exp(both - top).sum(1))
    marginal = np.exp(both[:, 1] - log_z)
    j = np.flatnonzero(np.append(text[1:] == text[:-1], False))
    pairs = np.exp(a[j][:, :, None] + pair + (u[j + 1] + b[j + 1])[:, None, :] - log_z[j][:, None, None]).sum(0)
    return marginal, pairs


class LineModel:
    """Weights of the field and the curve from good share to score."""

    prior = 0.5
    weights: np.ndarray | None = None

    def fit(self, x: np.ndarray, text: np.ndarray, size: np.ndarray, labels: np.ndarray, rounds: int = 3, steps: int = 150) -> LineModel:
        """x: features of lines; labels: of the texts, in ascending order of `text`."""
        self.prior = float(labels.mean()) if len(labels) else 0.5
        if len(set(labels.tolist())) < 2:
            return self
        z = with_neighbours(x, text)
        self.mean, self.spread = z.mean(0), np.where(z.std(0) > 1e-9, z.std(0), 1)
        self.mean[-1], self.spread[-1] = 0, 1
        z = (z - self.mean) / self.spread
        y = labels[text].astype(np.float64)
        _, first, count = np.unique(text, return_index=True, return_counts=True)
        # Long documents don't outweigh the rest, and the two kinds of document count alike.
        kind = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
        for _ in range(rounds):
            self._fit(z, text, y, (kind[text] / count[text]), steps)
            bad = 1 - chains(z @ self.weights, text, self.pair)[0]
            y = np.where(labels[text] == 1, 1.0, (bad < 0.5) * 1.0)
            for i in np.flatnonzero(labels == 0):
                span = slice(first[i], first[i] + count[i])
                y[span.start + np.argmax(bad[span] * np.minimum(size[span] + 1, 40))] = 0
        share = self.share(x, text, size)
        self.curve = np.zeros(2)
        for _ in range(200):  # Newton's method with a little damping
            p = 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * share)))
            g = np.array([(p - labels).sum(), ((p - labels) * share).sum() + 1e-3 * self.curve[1]])
            w = p * (1 - p) + 1e-9
            hess = np.array([[w.sum(), (w * share).sum()], [(w * share).sum(), (w * share * share).sum() + 1e-3]])
            step = np.linalg.solve(hess + 1e-6 * np.eye(2), g)
            self.curve -= np.clip(step, -5, 5)
            if abs(step).max() < 1e-8:
                break
        return self

    def _fit(self, z, text, y, weight, steps):
        """Adam on the weighted likelihood; the weight of a line is that of its document a line."""
        w, pair = np.zeros(z.shape[1]), np.zeros((2, 2))
        theta = np.append(w, pair)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        j = np.flatnonzero(text[1:] == text[:-1])
        true = np.zeros((2, 2))
        np.add.at(true, (y[j].astype(int), y[j + 1].astype(int)), 1.0)
        scale, links = weight.sum(), max(1, len(j))
        for t in range(1, steps + 1):
            marginal, pairs = chains(z @ theta[:-4], text, theta[-4:].reshape(2, 2))
            grad = np.append(z.T @ ((marginal - y) * weight) / scale, ((pairs - true) / links).ravel()) + 1e-3 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
            theta = theta - step
            if np.abs(step).max() < STILL:
                break
        self.weights, self.pair = theta[:-4], theta[-4:].reshape(2, 2)

    def share(self, x, text, size) -> np.ndarray:
        """Length-weighted mean marginal of good of each text."""
        good, _ = chains((with_neighbours(x, text) - self.mean) / self.spread @ self.weights, text, self.pair)
        weight = size + 1
        return np.bincount(text, weights=good * weight) / np.bincount(text, weights=weight)

    def score(self, texts: list[str]) -> np.ndarray:
        """Scores of whole texts."""
        if self.weights is None:
            return np.full(len(texts), self.prior)
        share = self.share(*line_features(texts))
        return 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * share)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 4000, lines: int = 400) -> LineModel:
    """Fit on at most `sample` labelled documents, those with the least hash of doc_id, and `lines` lines of each.

    Of a document with more lines a stretch is learned from that begins at a line
    given by the hash of its text.  Of several rows of one doc_id that with the least
    hash counts.  Only line features come to the driver, at most 44 * sample * lines
    bytes (70 MB).
    """
    picked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    picked = picked.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    small_batches(docs.sparkSession)
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    rows = rows.join(F.broadcast(picked), "doc_id")  # at most `sample` rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, y, h, text in zip(b["doc_id"].tolist(), b["y"].tolist(), b["h"].tolist(), b["text"], strict=True):
                x, _, size = line_features([text])
                at = h % (len(x) - lines + 1) if len(x) > lines else 0
                out.append((doc, y, h, x[at : at + lines].astype(np.float32).tobytes(), size[at : at + lines].astype(np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "y", "h", "x", "size"])

    found = rows.mapInPandas(lean(run), "doc_id long, y int, h long, x binary, size binary")
    found = found.groupBy("doc_id", "y").agg(F.min_by(F.struct("x", "size"), F.col("h")).alias("s")).select("doc_id", "y", "s.x", "s.size")
    got = sorted(found.collect(), key=lambda r: r["doc_id"])
    if not got:
        return LineModel()
    x = [np.frombuffer(r["x"], np.float32).reshape(-1, len(NAMES)).astype(np.float64) for r in got]
    size = np.concatenate([np.frombuffer(r["size"], np.float32) for r in got]).astype(np.float64)
    text = np.repeat(np.arange(len(got)), [len(a) for a in x])
    return LineModel().fit(np.concatenate(x), text, size, np.array([r["y"] for r in got]))


def score(docs: DataFrame, model: LineModel, *extra: str, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every whole text, and the `extra` columns."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *extra)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema) + ", score double, predicted int"
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some dozens of weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, out, at, held = b["text"].tolist(), [], 0, 0
            for i, t in enumerate(texts):
                held += len(t) + 1
                if held >= BATCH or i == len(texts) - 1:
                    out.append(shared.value.score(texts[at : i + 1]))
                    at, held = i + 1, 0
            s = np.concatenate([np.zeros(0), *out])
            yield b.drop(columns="text").assign(score=s, predicted=(s >= threshold).astype(np.int32))

    return rows.mapInPandas(lean(run), schema)
