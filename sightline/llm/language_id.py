"""Language identification by string kernels.

Two texts are compared by the character n-grams (blended over n = 1, 2, 3)
that are present in both: k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|).  A
Nystrom basis of landmark texts turns the kernel into features,
K(x, landmarks) K(landmarks, landmarks)^(-1/2), and kernel ridge regression of
each language against the rest is fitted on them.  A batch of texts is scored
by matrix products: presence, landmarks, weights.

Letters are folded to 63 symbols (a to z, and other letters by their code
point modulo 36); what is no letter is a gap, and runs of gaps are one.

A null text, or one with no letter, is `und` with score 0.  Rows with a null
label are never learned from.  Very long texts are read whole.  Repeated rows are
learned from once and predicted alike; ties go to the first language in order.
With no rows to learn from, every text is `und`.  Other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches
from .pieces import L, char_classes

SYMBOLS = 64
#: The best regression value below which a text is in none of the languages; for a text of fewer than SHORT different n-grams
#: the greatest kernel value with any landmark, below which it is in none.  ALIKE: the kernel value of texts that mix languages.
LEAST_VALUE, SHORT, LEAST, ALIKE = -0.12, 40, 0.1, 0.25


def symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter."""
    out = np.where(char_classes() == L, 27 + np.arange(0x110000) % 36, 0).astype(np.int32)
    out[65:91] = out[97:123] = np.arange(1, 27)
    for up in range(0x80, 0x10000):
        low = chr(up).lower()
        if len(low) == 1 and low != chr(up):
            out[up] = out[ord(low)]
    return out


_symbols: list[np.ndarray] = []


def grams(text: str) -> np.ndarray:
    """Codes of the distinct n-grams, n = 1, 2, 3, of the whole text; those of gaps alone are left out."""
    if not _symbols:
        _symbols.append(symbol_table())
    x = _symbols[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    x = np.concatenate([[0], x, [0]]).astype(np.int32)
    x = x[np.append(True, (x[1:] != 0) | (x[:-1] != 0))]
    seen = np.zeros(SYMBOLS**3 + SYMBOLS**2 + SYMBOLS, bool)
    seen[x] = True
    two = x[:-1] * SYMBOLS + x[1:]
    seen[SYMBOLS + two] = True
    seen[SYMBOLS + SYMBOLS**2 + two[:-1] * SYMBOLS + x[2:]] = True
    seen[[0, SYMBOLS, SYMBOLS + SYMBOLS**2]] = False
    return np.flatnonzero(seen).astype(np.int32)


class KernelModel:
    """Landmarks and one-against-rest weights."""

    def __init__(self, landmarks: list[np.ndarray], texts: list[np.ndarray], labels: list[str], ridge: float):
        self.classes = sorted(set(labels))
        every = np.unique(np.concatenate(landmarks))
        self.place = np.full(SYMBOLS**3 + SYMBOLS**2 + SYMBOLS, -1, np.int32)
        self.place[every] = np.arange(len(every))
        self.marks = np.zeros((len(every), len(landmarks)), np.float32)
        for k, g in enumerate(landmarks):
            self.marks[self.place[g], k] = 1 / np.sqrt(len(g))
        value, vector = np.linalg.eigh(self.kernel(landmarks).astype(np.float64))
        keep = value > 1e-6 * value.max()
        self.root = vector[:, keep] / np.sqrt(value[keep])
        features = np.hstack([self.kernel(texts) @ self.root, np.ones((len(texts), 1))])
        y = np.array([[1.0 if c == label else -1.0 for c in self.classes] for label in labels])
        weight = 1 / np.sqrt(np.array([labels.count(x) for x in labels]))  # languages count alike more nearly
        a = features * weight[:, None]
        self.weights = np.linalg.solve(features.T @ a + ridge * np.eye(features.shape[1]), a.T @ y)
        self.project = (self.root @ self.weights[:-1]).astype(np.float32)

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        """k of each text with each landmark."""
        out = np.empty((len(texts), self.marks.shape[1]), np.float32)
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            present = np.zeros((len(part), len(self.marks)), np.float32)
            for i, g in enumerate(part):
                p = self.place[g]
                present[i, p[p >= 0]] = 1 / np.sqrt(max(1, len(g)))
            out[at : at + len(part)] = present @ self.marks
        return out

    def values(self, texts: list[np.ndarray]) -> np.ndarray:
        """Regression values: 1 where a text belongs to the language, -1 where it belongs to the rest."""
        return self.of_kernel(self.kernel(texts))

    def of_kernel(self, kernel: np.ndarray) -> np.ndarray:
        return kernel @ self.project + self.weights[-1]

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Of each text and language; a sharpened softmax of the regression values."""
        value = 6 * self.values(texts)
        value = np.exp(value - value.max(1, keepdims=True))
        return value / value.sum(1, keepdims=True)


def fit(docs: DataFrame, label: str = "lang", sample: int = 1500, landmarks: int = 240, ridge: float = 0.05) -> KernelModel | None:
    """Fit on at most `sample` labelled rows of a table, spread over the labels; the first `landmarks` are the landmarks.

    Of each label those with the least hash of doc_id and text are taken, evenly
    by label, so the choice is the same at any partitioning.  Rows below a limit
    that lets through some more than `sample` of each label come to the driver
    (two numbers each), then the n-gram codes of those taken, never texts.
    """
    rows = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("d"), F.col(label).cast("string").alias("label"), "text").where(F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.xxhash64("d", "text"))
    count = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row per label
    least: dict[str, list[int]] = {}
    wanted = {name: 2 * sample + 100 for name in count}
    while wanted:
        below = F.lit(False)
        for name, n in wanted.items():
            below = below | ((F.col("label") == name) & (F.col("h") <= min(2**63 - 1, -(2**63) + 2**64 * n // count[name])))
        few: dict[str, list[int]] = {name: [] for name in wanted}
        for r in rows.where(below).select("label", "h").distinct().collect():  # about `wanted` rows per label
            few[r["label"]].append(r["h"])
        least |= {name: sorted(h)[:sample] for name, h in few.items()}
        wanted = {name: 8 * n for name, n in wanted.items() if len(few[name]) < sample and n < count[name]}  # repeated rows
    turns = sorted((turn, name, h) for name, hashes in least.items() for turn, h in enumerate(hashes))[:sample]
    if not turns:
        return None
    most = {name: h for _, name, h in turns}  # the last turn of each label

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"label": b["label"], "h": b["h"], "g": [grams(t) for t in b["text"]]})

    bound = F.lit(False)
    for name, h in most.items():
        bound = bound | ((F.col("label") == name) & (F.col("h") <= h))
    got = sorted(rows.where(bound).dropDuplicates(["label", "h"]).select("label", "h", "text").mapInPandas(lean(codes), "label string, h long, g array<int>").collect(), key=lambda r: r["h"])
    texts, labels = [np.array(r["g"], np.int32) for r in got], [r["label"] for r in got]
    if len(set(labels)) < 2:
        labels_order = list(range(min(landmarks, len(texts))))
    else:
        turns: dict[str, int] = {}
        rank = []
        for name in labels:
            turns[name] = turns.get(name, 0) + 1
            rank.append(turns[name])
        labels_order = sorted(range(len(texts)), key=lambda i: (rank[i], labels[i]))[:landmarks]
    return KernelModel([texts[i] for i in labels_order], texts, labels, ridge)


def predict(docs: DataFrame, model: KernelModel | None, *extra: str) -> DataFrame:
    """doc_id, lang_pred and score of every whole text, and the `extra` columns."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks x n-grams: bounded by `landmarks`
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema) + ", lang_pred string, score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            out = b.drop(columns="text")
            lang, score = np.full(len(b), "und", object), np.zeros(len(b))
            for at in range(0, len(b), 256):
                texts = [grams(t) if t else np.zeros(0, np.int32) for t in b["text"].iloc[at : at + 256]]
                some = [i for i, g in enumerate(texts) if len(g)]
                if m is not None and some:
                    s = m.scores([texts[i] for i in some])
                    best = s.argmax(1)
                    lang[[at + i for i in some]] = [m.classes[k] for k in best]
                    score[[at + i for i in some]] = s[np.arange(len(some)), best]
            yield out.assign(lang_pred=lang, score=score)

    return rows.mapInPandas(lean(run), schema)


def accept(docs: DataFrame, model: KernelModel | None, least: float = LEAST_VALUE) -> DataFrame:
    """The rows of a table that are in one of the model's languages, with all their columns.

    A text without a letter goes, and one whose regression value stays below `least`
    for every language (1 is what a language's own texts are fitted to, -1 what the
    rest is), unless its kernel value with a landmark is ALIKE or more, as with texts
    that mix the languages.  A text of fewer than SHORT different n-grams says too little for that;
    it goes if its kernel value with every landmark is below LEAST.  Without a model
    (no row has a label) lettered rows stay.  Nulls count as texts without a letter;
    very long texts are read whole; equal rows go or stay together.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks x n-grams: bounded by `landmarks`

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            keep = np.zeros(len(texts), bool)
            for at in range(0, len(texts), 256):
                codes = [grams(t) if t else np.zeros(0, np.int32) for t in texts[at : at + 256]]
                some = np.flatnonzero([len(g) > 0 for g in codes])
                if len(some) and m is None:
                    keep[at + some] = True
                elif len(some):
                    kernel = m.kernel([codes[i] for i in some])
                    short = np.array([len(codes[i]) < SHORT for i in some])
                    like = kernel.max(1)
                    keep[at + some] = np.where(short, like >= LEAST, (m.of_kernel(kernel).max(1) >= least) | (like >= ALIKE))
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)


def held_out(modulus: int, rest: int):
    """Whether crc32 of doc_id as text leaves this remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest, F.lit(False))
