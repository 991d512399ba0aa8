from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from wickline.llm.exact_dedup import exact_dedup
from wickline.llm.sharding import communication_matrix, hypergeometric, uniform_shards


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup_against_grouping(make_docs, odd_texts, keep):
    rows = [(i, t) for i, t in enumerate(odd_texts * 3)] + [(None, "one"), (None, "only null ids"), (7, "twice"), (7, "twice")]
    got = exact_dedup(make_docs(rows).repartition(5), keep=keep).collect()
    assert len(got) == len(rows)
    ids, sizes = {}, Counter()
    for i, t in rows:
        sizes[t or ""] += 1
        ids.setdefault(t or "", []).extend([] if i is None else [i])
    pick = min if keep == "smallest" else max
    for r in got:
        t = r.text or ""
        best = pick(ids[t]) if ids[t] else None
        assert (r.keep_id, r.group_size, r.kept) == (best, sizes[t], r.doc_id == best)
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup_of_empty_table_and_clashing_columns(spark, make_docs):
    assert exact_dedup(make_docs([])).count() == 0
    odd = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", 6, "y")], "doc_id long, text string, own_digest int, keep_id string")
    got = exact_dedup(odd, fan_in=2).collect()
    assert sorted((r.doc_id, r.own_digest, r.keep_id) for r in got) == [(1, 5, 1), (2, 6, 1)]
    with pytest.raises(ValueError):
        exact_dedup(odd, keep="any")


def test_hypergeometric_moments():
    rng = np.random.default_rng(1)
    for good, bad, draws in ((5, 7, 6), (1000, 3000, 900), (10, 0, 4), (0, 10, 4), (3 * 10**9, 5 * 10**9, 10**6)):
        got = [hypergeometric(rng, good, bad, draws) for _ in range(400)]
        share, total = good / (good + bad), good + bad
        sd = (draws * share * (1 - share) * (total - draws) / max(total - 1, 1)) ** 0.5
        assert all(max(0, draws - bad) <= g <= min(good, draws) for g in got)
        assert abs(np.mean(got) - draws * share) <= 4.5 * sd / 20 + 1e-9


def test_matrix_margins():
    matrix = communication_matrix([5, 0, 11, 4], [7, 7, 6], seed=3)
    assert [sum(line) for line in matrix] == [5, 0, 11, 4]
    assert [sum(col) for col in zip(*matrix)] == [7, 7, 6]


@pytest.mark.parametrize("n", [0, 1, 7, 1003])
def test_shards_are_exact_and_gapless(spark, n):
    df = spark.range(n).selectExpr("id", "'t' AS shard", "CAST(NULL AS string) AS bin", "1 AS `place`")
    got = uniform_shards(df, shards=4, seed=1).collect()
    assert sorted(r.id for r in got) == list(range(n))
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(n // 4 + (s < n % 4)))


def test_shards_are_uniform_and_native(spark):
    out = uniform_shards(spark.range(0, 4000, 1, 7), shards=4, seed=2)
    got = sorted(out.collect(), key=lambda r: r.id)
    places = np.array([r.shard * 1000 + r.slot for r in got])
    assert abs(np.corrcoef(np.arange(4000), places)[0, 1]) < 0.06
    for part in np.array_split(np.array([r.shard for r in got]), 8):
        assert (np.abs(np.bincount(part, minlength=4) - 125) < 50).all()
    plan = out._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExistingRDD"))


def test_string_ids_and_dotted_names(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x"), ("z", None), ("y", "")], "`the.id` string, `a.text` string")
    got = {r["the.id"]: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(df, id_col="the.id", text_col="a.text", keep="smallest").collect()}
    assert got == {"b": ("a", 3, False), "a": ("a", 3, True), None: ("a", 3, False), "z": ("y", 2, False), "y": ("y", 2, True)}
