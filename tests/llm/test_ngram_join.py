from __future__ import annotations

import random
import re

import pytest

from wickline.llm.components import components
from wickline.llm.ngram_join import JaccardJoin, jaccard_components

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_force(rows, width, percent):
    sets = []
    for _, text in rows:
        words = WORD.findall(lower(text))
        n = max(len(words) - width + 1, 1)
        sets.append({tuple(words[i : i + width]) for i in range(n)} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return sorted(((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("width,percent,bits", [(4, 85, 16), (5, 80, 14), (2, 50, 14)])
def test_against_brute_force(make_docs, near_copies, width, percent, bits):
    rule = JaccardJoin(width=width, percent=percent, table_bits=bits, group_size=4)
    got = jaccard_components(make_docs(near_copies), rule)
    rows = [(r.id, r.n_shingles, r.component_id) for r in got.collect()]
    assert sorted(rows, key=str) == brute_force(near_copies, width, percent)
    assert len({r[2] for r in rows}) < len(rows)


def test_odd_rows(make_docs, odd_texts):
    rows = [*enumerate(odd_texts), *enumerate(odd_texts, 50), (3, "one"), (None, "one"), (None, None), (None, "alone here")]
    got = jaccard_components(make_docs(rows), JaccardJoin(width=4, percent=85, table_bits=14))
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute_force(rows, 4, 85)
    assert got.filter("component IS NULL").count() == 0


def test_empty_table(make_docs):
    assert jaccard_components(make_docs([]), JaccardJoin(table_bits=14)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 230)] + [(7, 7), (230, 160), (300, 301), (301, 300)]
    links += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {n: n for e in links for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for u, v in links:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    assert all(got[n] == find(n) for n in got)
    assert set(root) - set(got) == {n for n in root if all(n not in e or e[0] == e[1] for e in links)}


def test_matrix_finds_all_links_without_stars(spark, make_docs, near_copies, monkeypatch):
    """The star step only saves work: with none of its links the result is the same."""
    from wickline.llm import ngram_join

    def nothing(shared, nodes, rows, rule):
        return shared.sparkSession.createDataFrame([], "u long, v long")

    monkeypatch.setattr(ngram_join, "_star_step", nothing)
    got = jaccard_components(make_docs(near_copies), JaccardJoin(width=3, percent=70, table_bits=14, group_size=4))
    assert sorted((r.id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(brute_force(near_copies, 3, 70))


def test_counters_leave_a_task_in_small_batches():
    import numpy as np
    import pyarrow as pa

    from wickline.llm import ngram_join as N

    rng, bits = random.Random(4), 19
    texts = [" ".join(str(rng.randrange(10**9)) for _ in range(300)) for _ in range(100)]
    sent = list(N._local_counts(4, bits)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))
    assert len(sent) == (1 << bits) // N.RANGE // N.SENT and max(b.num_rows for b in sent) == N.SENT
    counts = np.concatenate([N._unpacked(blob) for b in sent for blob in b.column(2).to_pylist()])
    keys = N.shingle_sets(pa.array(texts, pa.large_string()), 4)[1]
    assert (counts == np.bincount(N._bucket(keys, bits), minlength=1 << bits)).all()


def test_arrow_batches_are_bounded_inside_only(spark):
    from wickline.llm.scratch import batches_of

    def bytes_of(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    texts = spark.range(2000, numPartitions=1).selectExpr("repeat('x', 10000) AS text")
    with batches_of(spark, 4 << 20):
        inside = [r.n for r in texts.mapInArrow(bytes_of, "n long").collect()]
    assert spark.conf.get(key) == before and sum(inside) >= 2000 * 10000
    assert len(inside) > 3 and max(inside) < 5 << 20


def edited(base, places, mark):
    """``base`` with a word of its own at each of the places."""
    return " ".join(f"{mark}-{i}" if i in places else w for i, w in enumerate(base))


def written_rows(monkeypatch):
    """Rows of the tables that the join writes, by their names."""
    from wickline.llm import ngram_join

    rows, plain = {}, ngram_join.written

    def counted(df, label):
        table = plain(df, label)
        rows.setdefault(label, []).append(table.count())
        return table

    monkeypatch.setattr(ngram_join, "written", counted)
    return rows


def test_copies_just_below_the_limit_make_no_pairs(make_docs, monkeypatch):
    """Three words changed of 150: 135 of 159 shingles in common with the original, less
    with each other."""
    base = [f"w{i}" for i in range(150)]
    docs = [(0, " ".join(base)), *((k, edited(base, {k, k + 40, k + 80}, k)) for k in range(10, 50))]
    rows = written_rows(monkeypatch)
    got = jaccard_components(make_docs(docs), JaccardJoin(width=4, percent=85, table_bits=20))
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute_force(docs, 4, 85)
    assert rows["shared"][0] >= 40 * 11 and rows["pairs"][0] == 0


def test_near_copies_meet_in_the_middle_of_their_group(make_docs, monkeypatch):
    """Copies with one or two changed words link with the original, among many with five
    that link with none: no pairs are left, the random orders alone leave some."""
    base = [f"w{i}" for i in range(150)]
    docs = [(500, " ".join(base)), *((k, edited(base, {k, k + 50}, k)) for k in range(10, 50))]
    docs += [(k, edited(base, {k % 25 + 5 + 27 * j for j in range(5)}, k)) for k in range(100, 250)]
    rows = written_rows(monkeypatch)
    got = jaccard_components(make_docs(docs), JaccardJoin(width=4, percent=85, table_bits=20))
    found = sorted(((r.id, r.n_shingles, r.component_id) for r in got.collect()), key=str)
    assert found == brute_force(docs, 4, 85) and sum(c == 10 for _, _, c in found) == 41
    assert rows["pairs"][0] == 0


def test_common_shingles_of_a_group_make_no_rows(make_docs, monkeypatch):
    """Copies just below the limit share 13 shingles of their prefixes and need 12: only
    the rarest of them may bring two nodes together, not each that all of them have."""
    from wickline.llm import ngram_join

    base, rng = [f"w{i}" for i in range(150)], random.Random(11)
    docs = [(k, edited(base, set(rng.sample(range(150), 3)), k)) for k in range(120)]
    docs += [(500 + k, edited(base, {k, k + 50}, k)) for k in range(10, 30)] + [(600, " ".join(base))]
    met, plain = [], ngram_join.written

    def counted(df, label):
        table = plain(df, label)
        if label in ("shared", "open"):
            met.append(table.groupBy("token").count().selectExpr("sum(count * (count - 1) div 2) AS n").first().n or 0)
        return table

    monkeypatch.setattr(ngram_join, "written", counted)
    got = jaccard_components(make_docs(docs), JaccardJoin(width=4, percent=85, table_bits=20))
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute_force(docs, 4, 85)
    assert met[0] > 20_000 and met[1] < met[0] / 4


@pytest.mark.parametrize("words", [1, 1 << 16])
def test_rows_without_copies_stay_where_they_are(spark, monkeypatch, words):
    """One row of each set, whether the bit table is full or not; only rows that may
    have copies are joined with the nodes."""
    from pyspark.sql import functions as F

    from wickline.llm import ngram_join as N

    moved, plain = [], N._marked

    def told(*args):
        marked = plain(*args)
        moved.append(marked.filter("near").count())
        return marked

    monkeypatch.setattr(N, "_marked", told)
    monkeypatch.setattr(N, "FILTER_WORDS", words)
    rows = [(i, b"d%d" % (i if i < 900 else i % 20), 5, [i]) for i in range(1000)] + [(2000, None, 0, [])]
    profiles = N.written(spark.createDataFrame(rows, "row_id long, digest binary, n long, prefix array<long>"), "sets")
    same = profiles.filter("n > 0").groupBy("digest").agg(F.min("row_id").alias("node"), F.count("*").alias("copies"))
    first = N._first_rows(profiles, N.written(same, "nodes"))
    assert sorted(r.row_id for r in first.collect()) == list(range(900))
    assert len(moved) == 1 and (moved[0] < 200 if words > 1 else moved[0] > 200)


@pytest.mark.parametrize("percent", [85, 80, 50, 30])
def test_least_shared_prefix(spark, percent):
    from pyspark.sql import functions as F

    from wickline.llm import ngram_join as N

    def needed(a, b):
        rule = JaccardJoin(percent=percent)
        return -(-percent * (a + b) // (100 + percent)) - max(n - rule.prefix(n) for n in (a, b))

    rng = random.Random(percent)
    cases = [(a, b, b + rng.choice([0, 0, 1, 5, 30])) for a in range(1, 60) for b in range(1, 80)]
    df = spark.createDataFrame(cases, "a long, lo long, hi long")
    a, lo, hi = F.col("a"), F.col("lo"), F.col("hi")
    got = df.select("*", N._needed(percent, a, lo).alias("one"), N._least_needed(percent, a, lo, hi).alias("least")).collect()
    assert all(r.one == needed(r.a, r.lo) for r in got)
    for r in got:
        fit = [b for b in range(r.lo, r.hi + 1) if 100 * b >= percent * r.a and 100 * r.a >= percent * b]
        assert not fit or min(needed(r.a, b) for b in fit) - 1 - (r.hi > r.lo) < r.least <= min(needed(r.a, b) for b in fit)


def test_a_task_has_one_python_worker_and_small_batches(spark, make_docs, near_copies, monkeypatch):
    """Steps in Python that follow each other in a stage hold a worker each."""
    from wickline.llm import ngram_join, packing, quality

    def watch(module, step):
        seen, plain = [], module.written

        def told(df, label):
            plan = df._jdf.queryExecution().executedPlan().toString()
            seen.append((label, plan.count("MapInArrow"), spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")))
            return plain(df, label)

        monkeypatch.setattr(module, "written", told)
        step()
        return seen

    docs = make_docs(near_copies)
    joined = watch(ngram_join, lambda: jaccard_components(docs, JaccardJoin(width=4, percent=85, table_bits=14)))
    assert [n for label, n, _ in joined if label == "sets"] == [1, 1]
    for module, step in ((packing, lambda: packing.pack_documents(docs)), (quality, lambda: quality.assess(docs))):
        label, n, size = watch(module, step)[0]
        assert label in ("pieces", "profiles") and n == 1 and int(size) == 4 << 20
