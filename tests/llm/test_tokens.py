"""The tokenizer engine and the transducer against the libraries."""

import base64

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sightline.llm import token_counts
from sightline.llm.pieces import cut
from sightline.llm.tokens import tokens

ODD = ["", "  ", "a", "it's we'll I'd 're've x'S 'Twas !'s ' 's  's\n's", "hello   world \n\n foo\n", "12345 ab12 ½ ٣", "日本語テスト 中文", "😀😀 x​y　z", "<|endoftext|> a <|endoftext|>", "a\x1cb\x1f c\x85d", "'", "''s", "a''s", "'ll'", "  a", " \n a", "aaaa" * 90, "ﬁ ǅ ſ ẞ İ ΣΑΣ", "\U0010ffff\x00x", "don't.'re"]
piece = st.text(alphabet=st.sampled_from(list("abst'lr dv \n\t.!1é Σß中") + ["😀"]), max_size=40)


@pytest.fixture(scope="module")
def tik():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_ranks(tik):
    got = tokens(P.path("byte_bpe_50k.tiktoken"), False, False).encode(ODD)
    assert [x.tolist() for x in got] == [tik.encode_ordinary(t) for t in ODD]


@pytest.mark.parametrize(("name", "words"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_library_files(name, words):
    lib = Tokenizer.from_file(P.path(name))
    got = tokens(P.path(name), words, True).encode(ODD)
    assert [x.tolist() for x in got] == [lib.encode(t, add_special_tokens=False).ids for t in ODD]


@settings(max_examples=60, deadline=None)
@given(st.lists(piece, max_size=5))
def test_random_texts(tik, batch):
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert [x.tolist() for x in tokens(P.path("byte_bpe_50k.tiktoken"), False, False).encode(batch)] == [tik.encode_ordinary(t) for t in batch]
    want = [lib.encode(t, add_special_tokens=False).ids for t in batch]
    assert [x.tolist() for x in tokens(P.path("word_bpe_49k.json"), True, True).encode(batch)] == want
    assert token_counts.counter(P.path("word_bpe_49k.json")).count(batch).tolist() == list(map(len, want))


def test_transducer_long_words_and_chunks(monkeypatch):
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    batch = [*ODD, "ab" * 500, "supercalifragilistic " * 30, "x" * 97 + " y"]
    want = [len(lib.encode(t, add_special_tokens=False).ids) for t in batch]
    for chunk in (3, 96):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        assert token_counts.counter(P.path("word_bpe_49k.json")).count(batch).tolist() == want


def test_cuts_change_nothing(tik):
    text = "some words, it's  fine \n" * 500
    parts = cut(text, 100)
    assert "".join(parts) == text and len(parts) > 10
    assert [i for p in parts for i in tik.encode_ordinary(p)] == tik.encode_ordinary(text)


def test_forgetting_changes_nothing(tik):
    from sightline.llm.pieces import PieceEncoder

    t = tokens(P.path("byte_bpe_50k.tiktoken"), False, False)
    kept, t.encoder = t.encoder, PieceEncoder(t.merges, most=5)
    try:
        for text in ["one two three four five six seven", "seven eight nine ten one"] * 2:
            assert t.encode([text])[0].tolist() == tik.encode_ordinary(text)
    finally:
        t.encoder = kept
