"""Texts that are one long word, against the libraries."""

import random
import time

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe
from tokenizers import Tokenizer

from sightline.llm import token_counts
from sightline.llm.tokens import tokens

WORDS = P.path("word_bpe_49k.json")


def long_words():
    rng = random.Random(2)
    return {
        "letters": "".join(rng.choice("etaoinshrdlucmfw") for _ in range(120_000)),
        "one letter": "a" * 70_000,
        "pairs": "ab" * 40_000,
        "words": "".join(rng.choice(["the", "and", "stone", "river", "walk"]) for _ in range(20_000)),
        "others": "".join(rng.choice("日本語éüß") for _ in range(20_000)),
    }


@pytest.mark.parametrize("name", long_words())
def test_counts(name):
    text = long_words()[name]
    lib, began = Tokenizer.from_file(WORDS), time.time()
    texts = [text, "x " + text + " y", "two words"]
    got = token_counts.Counter(WORDS).count(texts).tolist()
    assert time.time() - began < 60
    assert got == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_blocks_and_cleared_states(monkeypatch):
    """States carried over the end of a block, the memory emptied in between."""
    monkeypatch.setattr(token_counts, "BLOCK", token_counts.CHUNK * 3)
    monkeypatch.setattr(token_counts, "MOST_STATES", 50)
    lib, rng = Tokenizer.from_file(WORDS), random.Random(5)
    texts = ["".join(rng.choice("abcde the and") for _ in range(rng.randrange(3000))) for _ in range(12)] + ["thequickbrown" * 300]
    assert token_counts.Counter(WORDS).count(texts).tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_bytes():
    path = P.path("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("bytes", pat_str=P.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    texts = [t[:30_000] for t in long_words().values()]
    for text, got in zip(texts, tokens(path, False, False).encode(texts), strict=True):
        assert np.array_equal(got, lib.encode(text))
