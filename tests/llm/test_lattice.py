from __future__ import annotations

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from wickline.llm.lattice import Lattice, LatticeModel, lattice, score_documents


@pytest.fixture(scope="module")
def grid() -> Lattice:
    return lattice()


def all_ways(grid, word, scores):
    """Every segmentation of a word: (log weight, pieces)."""
    s = "".join(grid.letters[b] for b in word.encode())
    for cuts in itertools.product([0, 1], repeat=len(s) - 1):
        places = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(s)]
        parts = [s[a:b] for a, b in zip(places, places[1:])]
        ids = [(grid.final if k == len(parts) - 1 else grid.inner).get(p) for k, p in enumerate(parts)]
        if None not in ids:
            yield sum(scores[i] for i in ids), ids


WORDS = ["a", "the", "there", "thread", "eaea", "naïve", "x|y", "🤦", "strengths"]


def test_forward_sums_all_segmentations(grid):
    scores = np.log(np.random.default_rng(1).dirichlet(np.ones(grid.size), 2).T)
    got = grid.log_probs(WORDS, scores)
    for w, word in enumerate(WORDS):
        for k in range(2):
            want = np.logaddexp.reduce([x for x, _ in all_ways(grid, word, scores[:, k])])
            assert math.isclose(got[w, k], want, rel_tol=1e-12)


def test_expected_uses(grid):
    scores = grid.prior()
    weights = np.array([[1.0, 0.0]] * 5 + [[2.0, 1.0]] * (len(WORDS) - 5))
    want = np.zeros((grid.size, 2))
    for w, word in enumerate(WORDS):
        ways = list(all_ways(grid, word, scores[:, 0]))
        total = np.logaddexp.reduce([x for x, _ in ways])
        for x, ids in ways:
            for i in ids:
                want[i] += math.exp(x - total) * weights[w]
    assert np.allclose(grid.expected(WORDS, scores, weights), want, atol=1e-12)


def test_long_words(grid):
    assert np.isfinite(grid.log_probs(["ab" * 30_000, "a"], grid.prior())).all()


def test_probabilities_of_words_and_end_sum_to_one():
    counts = np.array([[3.0, 0.0], [1.0, 5.0], [0.0, 2.0]])
    model = LatticeModel(["a", "b"], np.array([2.0, 1.0]), counts.sum(axis=0) + [2, 1], (counts > 0).sum(axis=0).astype(float), np.zeros((1, 2)))
    spelt = np.log(np.array([[0.5] * 2, [0.3] * 2, [0.2] * 2]))  # all the mass of the lattice
    total = (10.0 ** model.word_log10(counts, spelt)).sum(axis=0) + 10.0 ** model.end_log10()
    assert np.allclose(total, 1.0)


def test_scores_of_documents(make_docs, odd_texts):
    rng = random.Random(9)
    parts = {"en": ["the", "ing", "er", "and", "ion", "st"], None: ["der", "lich", "keit", "und", "ver", "sch"]}
    rows = [(i, t, rng.choice(["en", "xx", None]), "s", 0) for i, t in enumerate(odd_texts)]
    for i in range(200):
        lang = rng.choice(list(parts))
        words = ("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(60))
        rows.append((len(odd_texts) + i, " ".join(words), lang, "s", 0))
    rows += [(4, "One", "en", "s", 0), (None, "x", "y", "s", 0)]
    got = score_documents(make_docs(rows)).collect()
    assert len(got) == len(rows)
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    split = lambda t: [w for w in __import__("re").split("[\x20\x09-\x0d]+", lower(t)) if w]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts: dict = {}
    for i, t, *_ in rows:
        if not out(i):
            for w in [*split(t), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    by_id = {r.doc_id: r for r in got}
    for i, t, *_ in rows:
        if i == 4:
            continue
        r, tokens = by_id[i], [*split(t), None]
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(i), len(tokens), sum(w in counts for w in tokens), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    mine = [r for r in got if r.held_out and (r.doc_id or 0) >= len(odd_texts)]
    assert sum(r.score for r in mine) > sum(r.base_score for r in mine)


def test_tables_without_training_rows(make_docs):
    assert score_documents(make_docs([])).count() == 0
    alone = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    (r,) = score_documents(make_docs([(alone, "new words")])).collect()
    assert (r.held_out, r.n_known, r.train_tokens) == (True, 0, 0) and math.isfinite(r.score)
