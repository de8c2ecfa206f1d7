import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_sha256 string, score double, held_out boolean, _cuts string, _hash string, component_id long, id long, `key` long, n long, h long"
WORDS = ["the", "and", "of", "stone", "river", "Thing", "over", "über", "café", "night", "walk", "it's", "12", "we'll", "go,", "end."]


def words(rng, n):
    """Texts whose words are mostly distinct."""
    return " ".join(rng.choice(WORDS) + str(rng.randrange(10_000)) if rng.random() < 0.6 else rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """doc_id to text: nulls, empty and blank texts, copies, near copies, shared passages, one very long text, odd characters."""
    rng = random.Random(3)
    base, passage = words(rng, 200), words(rng, 80)
    near = base.split(" ")
    near[100] = "changed"
    far = base.split(" ")
    for k in range(0, 200, 7):
        far[k] = f"x{k}"
    fuzzy = passage.split(" ")
    for k in (10, 30, 50, 70):
        fuzzy[k] = "altered"
    out = {
        1: None,
        2: "",
        3: "   \n\t ",
        4: base,
        5: base,
        6: " ".join(near),
        7: " ".join(far),
        8: words(rng, 90) + "\n" + passage + "\n" + words(rng, 70),
        9: words(rng, 60) + "\n" + " ".join(fuzzy) + "\n" + words(rng, 40),
        10: words(rng, 40_000),
        11: "12345 !!! ###",
        12: "<|endoftext|> odd text 日本語 😀 İstanbul ΣΑΣ 're x'S <|startoftext|>",
        13: "a b c",
        14: "a b c",
        15: "a " * 3000,
        16: "".join(c.upper() if c.isascii() else c for c in base),
    }
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with nulls in every other column, clashing columns, and one row twice."""
    rows = [(i, t, None if i % 4 == 0 else "en", None, None, "x", None, None, "y", "z", 7, 7, 7, 7, 7) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
