from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from wickline.llm import catalog
from wickline.llm.collocations import BurstTrie, Mining, Node, TaskCounter, collocations

PARTS = re.compile("[.,;:!?\x0a-\x0d]")
WORD = re.compile("[^\x20\x09]+")


def brute_force(rows, rule):
    """(lang, rank, phrase, a, l, r, n, score), by counting every phrase in a dict."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in PARTS.split(lowered):
            words = WORD.findall(piece)
            totals[lang or "und"] += len(words)
            for n in range(1, rule.longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        candidates = [p for p, a in f.items() if len(p) > 1 and a >= rule.support]
        found = []
        for p in candidates:
            a = f[p]
            inside = any(
                100 * f[q] >= rule.contained * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q in candidates
                if len(q) > len(p)
            )
            if not inside:
                score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[: rule.top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def invented(n, seed=1):
    rng = random.Random(seed)
    common = ["the", "The", "of", "new", "york", "city", "é", "ß7", "日本", "x" * 300]
    joint = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]
    rows = []
    for _ in range(n):
        words = [rng.choice(common) if rng.random() < 0.8 else f"w{rng.randrange(3000)}" for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice(joint) for w in words)
        rows.append((rng.choice(["en", "de", None]), text + " new york city hall " * rng.randint(0, 2)))
    return rows


def result(df, rule):
    return sorted(map(tuple, collocations(df, rule).collect()))


@pytest.mark.parametrize("rule", [Mining(support=5), Mining(support=2, top=40, burst=8, held=50), Mining(longest=2, support=3), Mining(longest=3, contained=30, support=3)])
def test_against_brute_force(spark, odd_texts, rule):
    rows = invented(150) + [("en", t) for t in odd_texts] + [("xx", None)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert result(df, rule) == brute_force(rows, rule)


def test_registered_query(spark, make_docs, tmp_path):
    rows = invented(400, seed=8)
    make_docs([(i, t, g, "s", None) for i, (g, t) in enumerate(rows)]).toPandas().to_parquet(tmp_path / "documents.parquet")
    got = catalog.QUERIES["op12_burst_collocations"](spark, str(tmp_path))
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5
    rows = sorted(map(tuple, got.collect()))
    assert rows == brute_force(invented(400, seed=8), Mining()) and len(rows) > 20


def spilled(trie, down_to):
    words, n = trie.spill(down_to)
    keys = list(zip(*(w.tolist() for w in words)))
    assert keys == sorted(keys)
    return dict(zip(keys, n.tolist()))


def test_trie_bursts_and_spills():
    rng = np.random.default_rng(3)
    trie, seen, wanted = BurstTrie(burst=4, width=4), Counter(), Counter()
    for _ in range(30):
        words = [rng.integers(1, 200, 60), *(rng.integers(0, 3, 60) for _ in range(3))]
        wanted.update(zip(*(w.tolist() for w in words)))
        trie.add(words)
        assert trie.entries == sum(trie.sizes.values()) == sum(len(x) for x in trie._leaves(trie.roots))
        seen.update(spilled(trie, 300))
        assert trie.entries <= 300
    first = next(iter(trie.roots.values()))
    assert isinstance(first, Node) and any(isinstance(n, Node) for n in first.values())
    seen.update(spilled(trie, 0))
    assert seen == wanted and trie.entries == 0


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_runs_are_whole(width):
    counter = TaskCounter([width], Mining(held=20), None)
    texts = [b"a b c d e a b c f a b", b"b c d b c e. b c a"]
    runs = list(counter.add("en", texts)) + list(counter.add("de", texts[:1])) + list(counter.finish())
    counts = Counter()
    for run in runs:
        for group, first, rest, n in zip(*(c.to_pylist() for c in run.columns)):
            counts[group, (first + b" " + rest).decode().strip()] += n
    wanted = Counter()
    for group, text in (("en", texts[0]), ("en", texts[1]), ("de", texts[0])):
        for piece in text.decode().split("."):
            w = piece.split()
            wanted.update((group, " ".join(w[i : i + width])) for i in range(len(w) - width + 1))
    assert counts == wanted


def test_products_beyond_64_bits(spark):
    from wickline.llm.collocations import _scored, _uncontained

    big = 6_000_000_000_000_000
    phrases = spark.createDataFrame([("g", "a b", big), ("g", "a", big + 1), ("g", "b", big * 2), ("g", "a b c", big // 5 * 4)], "group string, phrase string, a long")
    scored = _scored(phrases.filter("phrase = 'a b'"), phrases).collect()
    assert [(r.l, r.r, r.score) for r in scored] == [(big + 1, big * 2, 2000000 * big // (3 * big + 1))]
    assert [r.phrase for r in _uncontained(phrases.filter("phrase like '% %'"), 80).collect()] == ["a b c"]


def test_clashing_columns_and_empty(spark, make_docs):
    df = spark.createDataFrame([("en", "a b " * 40, 1, 2, "x")], "lang string, text string, n long, rank long, phrase string")
    assert result(df, Mining()) == brute_force([("en", "a b " * 40)], Mining())
    assert collocations(make_docs([])).count() == 0
    assert collocations(make_docs([(1, None), (2, "")])).count() == 0
    with pytest.raises(ValueError):
        collocations(df, Mining(longest=5))


def test_longer_phrases_are_named_only_if_their_hashes_are_frequent(spark):
    """All pairs of these words are frequent, hardly any longer phrase is."""
    import random

    from pyspark.sql import functions as F
    from wickline.llm import collocations as C

    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(12)}" for _ in range(100)) + " w1 w2 w3 w4 ." for _ in range(60)]
    df = spark.createDataFrame([("en", t) for t in texts], "group string, text string")
    rule = C.Mining()
    words = C.count_phrases(df, [1], rule, [])
    pairs = C.frequent_hashes(df, [2], rule, [C.common_phrases(words, 1)], 6000)
    longer = C.frequent_hashes(df, [3, 4], rule, [pairs], 6000)
    by_pairs, by_all = (C.count_phrases(df, [3, 4], rule, known) for known in ([pairs], [pairs, longer]))
    assert 5 * by_all.count() < by_pairs.count()
    frequent = [{(r.phrase, r.a) for r in found.filter(F.col("a") >= rule.support).collect()} for found in (by_pairs, by_all)]
    assert frequent[0] == frequent[1] and "w1 w2 w3 w4" in {p for p, _ in frequent[0]}


def test_runs_of_hashes_are_short():
    import numpy as np
    from wickline.llm import collocations as C

    rng = np.random.default_rng(1)
    key = np.unique(rng.integers(0, 1 << 64, 200_000, np.uint64) & C.KEPT)
    run = C._packed(key, np.ones(len(key), np.int64))
    assert len(run) < 4 * len(key) and (C._unpacked(run)[0] == key).all()
