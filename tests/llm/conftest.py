from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, schema=SCHEMA):
        full = [(i, t, "en", "s", None) if schema == SCHEMA and len(r) == 2 else r for r in rows for i, t in [r[:2]]]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, odd characters, very long texts."""
    return [
        None,
        "",
        " \t\n\x0b\x0c\r ",
        "one",
        "One",
        "a b c",
        "x" * 30_000,
        "word " * 20_000,
        "Ünïcödé ΣΑΣ İstanbul    中文 🤦 é",
        "a\x1cb \x85 c",
        "<|endoftext|> in <|startoftext|>text's",
        "line\n\nline\nLINE \n other",
        "\r\n\r\nWARC/1.1\r\n\r\n",
    ]


@pytest.fixture(scope="session")
def near_copies():
    """Random texts with edited copies: (id, text)."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(400)]
    rows = []
    for g in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(3, 160))]
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy).capitalize())
    rng.shuffle(rows)
    return list(enumerate(rows, 100))
