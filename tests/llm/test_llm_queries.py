"""The registered queries against their SQL, and the pipeline against brute force."""

from __future__ import annotations

import os
import random

import pytest

import corpus_pipeline
from oracle import connect, difference
from wickline.llm import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def test_every_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))
    assert set(catalog.STATEMENTS) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", list(catalog.STATEMENTS))
def test_query_matches_sql(spark, name):
    assert difference(spark, connect(SF_DIR), catalog.QUERIES[name], catalog.STATEMENTS[name], SF_DIR) is None


def test_pipeline_stages(spark, make_docs):
    from test_ngram_join import brute_force

    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(500)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(12, 120))]
        for _ in range(rng.choice([1, 2, 4])):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += texts[:10] + ["too short", None, "", "a b c d e " * 9]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    docs = make_docs(rows)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        out[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good = [(i, t) for i, t in rows if i < len(texts) - 4]
    assert sorted((r.doc_id, r.text) for r in out["quality_rules"]) == sorted(good)
    first = {}
    for i, t in good:
        first[t] = min(i, first.get(t, i))
    assert sorted((r.doc_id, r.text) for r in out["exact_duplicates"]) == sorted((i, t) for t, i in first.items())
    left = sorted((i, t) for t, i in first.items())
    kept = {c for _, _, c in brute_force(left, 5, 80)}
    assert sorted(r.doc_id for r in out["near_duplicates"]) == sorted(kept)
    assert {r.doc_id for r in out["packing"]} == kept


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, digest string, id_key string, id string, text_hash long, component long, kept boolean, removed int"


@pytest.mark.parametrize("rows", [[], [(1, "a b c d e f g h i j k l", "x"), (2, "a b c d e f g h i j k l", "y"), (None, "m n o p q r s t u v w", "z"), (3, None, "n"), (4, "word " * 30_000, "l"), (4, "", "e")]])
def test_stages_with_odd_rows_and_clashing_columns(spark, rows):
    full = [(i, t, "en", None, None, mark, mark, mark, 7, 8, True, 9) for i, t, mark in rows]
    docs = spark.createDataFrame(full, CLASHING)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == CLASHING.replace(",", "").split()[::2]
    if rows:
        assert sorted((r.doc_id is None, r.doc_id or 0, r.digest) for r in kept["exact_duplicates"]) == [(False, 1, "x"), (True, 0, "z")]
        assert {r.doc_id for r in kept["packing"]} == {1, None}
    else:
        assert not any(kept.values())
