"""Whole-text token ids of the public vocabularies, batch by batch."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from . import pieces as P

#: Characters handled in one array pass; a longer text is cut at places where a piece begins.
BATCH = 400_000


def lower_nfc(text: str) -> str:
    """NFC, then each character's lower case by itself."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Tokens:
    """Ids of texts by one vocabulary file.

    words: the split and the lower-casing of word_bpe_49k, else those of
    byte_bpe_50k.  special: strings that the library takes as one token even
    inside a text; a text holding one is left to the library itself.
    """

    def __init__(self, path: str, words: bool, special: bool):
        self.path, self.words = path, words
        self.merges, self.names = P.merges_of(path)
        self.encoder = P.PieceEncoder(self.merges)
        self.library, self.special = None, []
        if special:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as an array."""
        out: list = [None] * len(texts)
        part: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            bits = P.cut(text, BATCH) if len(text) > BATCH else [text]
            for t in bits:
                part.append((i, t))
                size += len(t)
                if size >= BATCH:
                    self._run(part, out)
                    part, size = [], 0
        self._run(part, out)
        return out

    def _run(self, part: list[tuple[int, str]], out: list) -> None:
        if not part:
            return
        texts = [lower_nfc(t) for _, t in part] if self.words else [t for _, t in part]
        cp, kinds, ends = P.code_points(texts)
        start = (P.split_words if self.words else P.split_spaced)(cp, kinds)
        stop = np.append(start[1:], len(cp))
        kind = kinds[start]
        keep = (kind < P.E) & (kind != P.S) if self.words else kind < P.E
        start, stop = start[keep], stop[keep]
        rows = self.encoder.lookup(cp, start, stop)
        ids = self.encoder.ids(rows)
        last = np.append(0, np.cumsum(self.encoder.size[rows]))[np.searchsorted(start, ends)]
        at = 0
        for (i, _), b in zip(part, last.tolist(), strict=True):
            out[i] = ids[at:b] if out[i] is None else np.concatenate([out[i], ids[at:b]])
            at = b


@lru_cache(4)
def tokens(path: str, words: bool, special: bool) -> Tokens:
    """One per Python worker."""
    return Tokens(path, words, special)
