from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from wickline.llm.quality import QualityRules, apply_rules, assess

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    words = WORD.findall(text or "")
    fives = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if fives[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
    )


def as_counts(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)


def test_counts_against_loops(make_docs, odd_texts):
    rng = random.Random(6)
    texts = list(odd_texts)
    for _ in range(300):
        texts.append("".join(rng.choice(["a ", "bé ", "c\n", "#d ", "\t", "a bé c a bé ", "\n", "\r", " x|"]) for _ in range(rng.randint(0, 60))))
    got = {r.id: r for r in assess(make_docs(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        n = counts(text)
        assert as_counts(got[str(i)]) == n, repr(text)
        assert got[str(i)].base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])


def rows_with_common_line():
    own = lambda i, k: " ".join(f"w{i}x{j}" for j in range(k))
    rows = [(i, f"Shared  LINE of all\n{own(i, 12)}", "h1") for i in range(6)]
    rows += [(10, "shared line of ALL\nshared line of all\nshared\tline of all\na", "h1")]
    rows += [(20 + i, f"shared line of all\n{own(i, 12)}", "h2") for i in range(2)]
    copies = own(99, 12) + "\nonly in copies"
    return rows + [(30 + i, copies, "h1") for i in range(9)] + [(None, None, None), (41, "", None)]


def test_lines_above_the_limits(spark):
    rules = QualityRules(line_docs=5, keep_share=0.2)
    df = spark.createDataFrame(rows_with_common_line(), "doc_id long, text string, source string")
    got = {r.id: r for r in assess(df, rules).collect()}
    assert len(got) == df.count()
    assert all(got[str(i)].removed == [0] and got[str(i)].kept for i in range(6))
    assert got["10"].removed == [0, 1, 2] and not got["10"].kept and not got["10"].base_failed  # depleted
    assert all(got[str(i)].removed is None for i in (20, 21))  # another host
    assert all(got[str(i)].removed is None and got[str(i)].kept for i in range(30, 39))  # copies count once
    assert not got[None].kept and not got["41"].kept


def test_applied_rules(spark):
    rules = QualityRules(line_docs=5, keep_share=0.2)
    df = spark.createDataFrame(rows_with_common_line(), "doc_id long, text string, source string")
    df = df.selectExpr("*", "length(text) AS n_chars", "'x' AS own_id", "1 AS removed")
    out = apply_rules(df, rules, chars_col="n_chars")
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {*range(6), 20, 21, *range(30, 39)}
    assert got[0].text == " ".join(f"w0x{j}" for j in range(12)) and got[0].n_chars == len(got[0].text)
    assert got[20].text.startswith("shared line")
    twice = apply_rules(df.union(df), rules).groupBy("doc_id").count().collect()
    assert {r["count"] for r in twice} == {2}


@pytest.mark.parametrize("run", [assess, apply_rules])
def test_empty_table(make_docs, run):
    assert run(make_docs([])).count() == 0


def shared_lines(n, host="h", lines=1):
    body = "\n".join(f"shared words of line {k}" for k in range(lines))
    return [(i, f"{body}\n" + " ".join(f"w{i}x{j}" for j in range(12)), "en", host, None) for i in range(n)]


def test_sql_where_lines_go(spark, make_docs, tmp_path):
    from oracle import connect, difference
    from wickline.llm import catalog

    rows = shared_lines(11, lines=20) + [(1000 + r[0], *r[1:]) for r in shared_lines(10, host="g", lines=20)]
    make_docs(rows).coalesce(1).toPandas().to_parquet(tmp_path / "documents.parquet")
    query = catalog.QUERIES["op9_line_frequency"]
    assert difference(spark, connect(str(tmp_path)), query, catalog.STATEMENTS["op9_line_frequency"], str(tmp_path)) is None
    got = query(spark, str(tmp_path)).collect()
    assert sum(not r.kept and not r.base_failed for r in got) == 11 and all(r.kept for r in got if r.doc_id >= 1000)


def test_near_copies_above_the_limits_are_all_depleted(make_docs):
    got = apply_rules(make_docs(shared_lines(11, lines=20) + [(500, "w " + " ".join(f"v{j}" for j in range(20)), "en", "h", None)]))
    assert [r.doc_id for r in got.collect()] == [500]


def test_one_limit_at_every_size(make_docs):
    """A line of eleven texts goes whether they are all of its host or few of it."""
    others = [(1000 + i, " ".join(f"o{i}x{j}" for j in range(12)), "en", "h", None) for i in range(1500)]
    for rest in ([], others):
        got = {r.id: r.removed for r in assess(make_docs(shared_lines(11) + rest)).collect()}
        assert all(got[str(i)] == [0] for i in range(11)) and sum(x is not None for x in got.values()) == 11
