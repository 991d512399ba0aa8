from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wickline.llm import catalog
from wickline.llm.resampling import Resampling, crc_joined, resample, scan_words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def features(text):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_force(rows, target, buckets=10_000, min_words=20, percent=5):
    """(doc_id, n_features, weight, score, rank) of every row, feature by feature."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    corpus = Counter(bucket(f) for _, t in rows for f in features(t))
    goal = Counter(bucket(f) for t in target for f in features(t))
    s_all, t_all = sum(corpus.values()), sum(goal.values())
    out = []
    for i, t in rows:
        fs = features(t)
        gains = [math.floor(1000 * math.log((goal[b] + 1) * (s_all + buckets) / ((corpus[b] + 1) * (t_all + buckets)))) for b in map(bucket, fs)]
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        score = sum(gains) + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(fs), sum(gains), score, None, len(words_of(t))])
    eligible = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(eligible[: percent * len(eligible) // 100], 1):
        r[4] = k
    return sorted(tuple(r[:5]) for r in out)


def invented(n, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé7日") for _ in range(rng.randint(1, 6))) for _ in range(200)] + ["x" * 70, "The", "Y" * 200]
    joint = [" ", "  ", "-", "\n", ", ", "\x7f", "_"]
    return ["".join(rng.choice(vocabulary) + rng.choice(joint) for _ in range(rng.randint(0, 90))) for _ in range(n)]


def test_crc_of_joined_parts():
    rng = random.Random(1)
    parts = [rng.randbytes(rng.choice([0, 1, 5, 63, 64, 65, 300])) for _ in range(400)]
    a, b = parts[::2], parts[1::2]
    got = crc_joined(np.array([*map(zlib.crc32, a)], np.uint32), np.array([*map(zlib.crc32, b)], np.uint32), np.array([*map(len, b)]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


def test_scanned_words(odd_texts):
    texts = [t or "" for t in odd_texts] + invented(30)
    owner, crc, length = scan_words([t.encode() for t in texts])
    wanted = [(k, zlib.crc32(w.encode()), len(w.encode())) for k, t in enumerate(texts) for w in words_of(t)]
    assert list(zip(owner.tolist(), crc.tolist(), length.tolist())) == wanted


def test_against_brute_force(spark, make_docs, odd_texts):
    rows = list(enumerate(odd_texts + invented(300)))
    rows += [(1000 + i, rows[20 + i][1]) for i in range(5)]
    target = invented(20, seed=9) + [None, ""]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample(make_docs(rows).repartition(5), goal)
    assert sorted((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got.collect()) == brute_force(rows, target)


def test_registered_query(spark, tmp_path, make_docs):
    rows = list(enumerate(invented(120)))
    make_docs(rows).toPandas().to_parquet(tmp_path / "documents.parquet")
    target = invented(8, seed=4)
    spark.createDataFrame(list(enumerate(target)), "item_id long, text string").toPandas().to_parquet(tmp_path / "benchmark.parquet")
    got = catalog.QUERIES["op13_importance_resampling"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == brute_force(rows, target)


def test_sample_moves_to_the_target(spark, make_docs):
    rng = random.Random(2)
    plain = [" ".join(rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(60)) for _ in range(300)]
    wanted = [" ".join(rng.choice(["uv", "wx", "yz"]) for _ in range(60)) for _ in range(40)]
    rows = list(enumerate(plain + wanted[:20]))
    goal = spark.createDataFrame([(t,) for t in wanted[20:]], "text string")
    drawn = [r.doc_id for r in resample(make_docs(rows), goal).filter("rank is not null").collect()]
    assert len(drawn) == 16 and all(i >= 300 for i in drawn)


def test_repeated_rows_null_ids_and_other_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, 7, "x"), (1, text, 8, "y"), (None, text, 9, "z"), (2, None, 0, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score long, rank string").withColumnRenamed("doc_id", "a.id")
    goal = spark.createDataFrame([(text,)], "`t.t` string")
    got = resample(df, goal, Resampling(percent=100), id_col="a.id", target_text_col="t.t").collect()
    assert sorted(r.rank for r in got if r.rank) == [1, 2, 3]
    assert len({r.score for r in got if r["a.id"] == 1}) == 1
    assert [(r.n_features, r.weight, r.rank) for r in got if r["a.id"] == 2] == [(0, 0, None)]


@pytest.mark.parametrize("docs, goal", [([], []), ([], ["a b"]), ([(1, "a " * 30)], [])])
def test_empty_tables(spark, make_docs, docs, goal):
    got = resample(make_docs(docs), spark.createDataFrame([(t,) for t in goal], "text string")).collect()
    assert len(got) == len(docs)
