"""Toxicity by logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal.

Features of a text are the words, the pairs of neighbouring words, and the pairs
with one or two words between, each hashed to one of 2^bits places; a place counts
once a text, so a long clean text adds nothing to a short toxic passage but the few
places that have a weight at all.  FTRL-proximal learns a text at a time with a
rate of its own for each place; its L1 term keeps every place at zero whose
gradients do not add up, so that some thousands of (place, weight) pairs are left,
which are broadcast.

A null or empty text has no features and gets the score of the bias alone; very
long texts are scored whole, some megabytes at a time; repeated rows get
equal scores, and ties cannot arise, since rows are scored by themselves.  Labels
that are null, or rows without a text, are not learned from; with no labels of both
kinds every score is the share of toxic ones (0 without any).  An empty table gives
an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, lean
from .shingles import BREAKS, helpings, word_hashes

BITS = 20
#: Words between the two of a pair; odd multipliers tell the kinds of feature apart.
GAPS = (0, 1, 2)
#: A text of more bytes is read in slices of about so many, cut at words.
SLICE = 4 << 20
#: Marks at the ends of a word that are no part of it.
EDGE = b".,;:!?\"'()[]"


_BARE = bytes(0x20 if c in EDGE else c for c in range(256))


def _places(h: np.ndarray, words: list[int], bits: int) -> list[np.ndarray]:
    """Distinct places of the features of each text; h: hashes of all words, words: how many each text has."""
    shift = np.uint64(64 - bits)
    kinds = [(h * np.uint64(0x9E3779B97F4A7C15)) >> shift]
    for gap in GAPS:
        left, right = h[: max(0, len(h) - gap - 1)], h[gap + 1 :]
        kinds.append((((left * np.uint64(0xC2B2AE3D27D4EB4F + 2 * gap)) ^ (right + (right << np.uint64(17)))) * np.uint64(0x165667B19E3779F9)) >> shift)
    out, at = [], 0
    for n in words:
        own = [k[at : max(at, at + n - skip)] for k, skip in zip(kinds, (0, *(gap + 1 for gap in GAPS)), strict=True)]
        out.append(np.unique(np.concatenate(own)).astype(np.int32))
        at += n
    return out


def _slices(text: bytes) -> Iterator[bytes]:
    """Parts of a text, cut between words; a word longer than a slice stays whole."""
    at = 0
    while at < len(text):
        cut = at + SLICE
        while cut < len(text) and text[cut] not in BREAKS:
            cut += 1
        yield text[at:cut]
        at = cut


def features(texts: list[str], bits: int = BITS) -> list[np.ndarray]:
    """Distinct places of each text, ascending."""
    raw = [t.encode().translate(_BARE) for t in texts]
    out: list[np.ndarray] = []
    for lo, hi in helpings(raw):
        if hi - lo == 1 and len(raw[lo]) > SLICE:
            h = np.concatenate([word_hashes([part])[0] for part in _slices(raw[lo])])
            found = np.zeros(0, np.int32)
            for at in range(0, len(h), SLICE // 8):
                part = h[at : at + SLICE // 8 + max(GAPS) + 1]  # pairs go on into the next part
                found = np.union1d(found, _places(part, [len(part)], bits)[0])
            out.append(found)
        else:
            h, _, _, words = word_hashes(raw[lo:hi])
            out += _places(h, words.tolist(), bits)
    return out


class ToxicModel:
    """Places with a weight, their weights, and the bias."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, bias: float, prior: float | None = None):
        self.places, self.weights, self.bias, self.prior = places, weights, bias, prior

    def score(self, texts: list[str]) -> np.ndarray:
        """Scores of whole texts."""
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        out = np.full(len(texts), self.bias)
        for i, at in enumerate(features(texts)):
            out[i] += self.weights[np.searchsorted(self.places, at[np.isin(at, self.places)])].sum()
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


class Ftrl:
    """FTRL-proximal: z and n a place; the weight is zero while |z| is within l1."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias, without l1
        self.alpha, self.beta, self.l2 = alpha, beta, l2
        self.l1 = np.append(np.full(size, l1), 0.0)

    def weight(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], self.l1[at]
        return -np.sign(z) * np.maximum(0, np.abs(z) - l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, y: int, worth: float) -> None:
        """One text: its places with the bias, its label, and how much it counts."""
        w = self.weight(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y) * worth
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 8000, most: int = 4096, rounds: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 12.0, l2: float = 0.1) -> ToxicModel:
    """Fit on at most `sample` labelled documents, those with the least hash of doc_id.

    Only numbers of places come to the driver, at most `most` of a text (those
    with the least number: an even choice of features, alike in all texts), which
    is 128 MB in all at the default bounds.  Of the rows of one doc_id that with the least
    text hash is learned from.
    """
    picked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    picked = picked.groupBy("doc_id").agg(F.max("y").alias("y"))
    docs = documents(docs.where(F.col("text").isNotNull()))
    # Labels of documents that are not there take no place of the sample: a shuffle of ids only.
    picked = picked.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.join(F.broadcast(picked), "doc_id")  # at most `sample` rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = [f[np.argsort(_even(f), kind="stable")[:most]] for f in features(b["text"].tolist())]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "at": [np.sort(a).tobytes() for a in at]})

    found = rows.mapInPandas(lean(run), "doc_id long, y int, at binary").groupBy("doc_id", "y").agg(F.min_by("at", F.xxhash64("at")).alias("at"))
    got = sorted(found.collect(), key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15) % 2**64)  # at most `sample` rows of 4 * `most` bytes
    toxic = sum(r["y"] for r in got)
    if not 0 < toxic < len(got):
        return ToxicModel(np.zeros(0, np.int32), np.zeros(0), 0.0, toxic / len(got) if got else 0.0)
    size = 1 << BITS
    model = Ftrl(size, alpha, beta, l1, l2)
    worth = {1: (len(got) / (2 * toxic)) ** 0.5, 0: (len(got) / (2 * (len(got) - toxic))) ** 0.5}  # the rarer kind counts more
    texts = [(np.append(np.frombuffer(r["at"], np.int32), size), r["y"]) for r in got]
    for _ in range(rounds):
        for at, y in texts:
            model.learn(at, y, worth[y])
    weights = model.weight(np.arange(size + 1))
    places = np.flatnonzero(weights[:-1])
    return ToxicModel(places.astype(np.int32), weights[places], float(weights[-1]))


def _even(places: np.ndarray) -> np.ndarray:
    """An order of places that has nothing to do with what they stand for."""
    return (places.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)


def score(docs: DataFrame, model: ToxicModel, *extra: str, threshold: float = 0.5) -> DataFrame:
    """doc_id, the `extra` columns, score and predicted of every whole text."""
    rows = documents(docs, *extra)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema) + ", score double, predicted int"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2^BITS places, some thousands in practice

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = shared.value.score(b["text"].tolist())
            yield b.drop(columns="text").assign(score=s, predicted=(s >= threshold).astype(np.int32))

    return rows.mapInPandas(lean(run), schema)
