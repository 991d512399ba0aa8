from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from wickline.llm import bpe, tokens
from wickline.llm.packing import LocalSearch, best_fit, pack, pack_documents, pack_pieces
from wickline.llm.scratch import fresh_path
from wickline.llm.token_counts import count_tokens

ODD = list("abXY'sStTrE  .,!012\t\n\x1c\x85\xa0éÉñßΣσİıſŉ中字🤦̸́ǅ’-<|>") + ["<|endoftext|>", "<|startoftext|>", "가", "ﬁ", "q" * 30]


@pytest.fixture(scope="module")
def random_texts(odd_texts):
    rng = random.Random(2)
    return [t or "" for t in odd_texts] + ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(1500)]


def expected(text):
    return tokens.load(tokens.WORD_BPE).encode(text, add_special_tokens=False).ids


def test_chunks_give_the_ids_of_the_library(random_texts):
    small = tokens.ChunkEncoder(words=50, chunks=50)
    for text, ids in zip(random_texts, small.encode(random_texts)):
        assert np.frombuffer(ids, "<u4").tolist() == expected(text)


def test_segment_tree_gives_the_ids_and_texts_of_the_library(random_texts):
    own = bpe.CachedBPE(words=40, chunks=40)
    library = tokens.load(tokens.WORD_BPE)
    for text in random_texts:
        ids = expected(text)
        assert own.encode(text) == ids
        assert own.both(text) == (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))


def test_segment_tree_takes_the_leftmost_lowest_rank():
    tree = bpe.SegmentTreeBPE()
    rng = random.Random(4)
    for _ in range(400):
        letters = "".join(rng.choice("aehlnorst") for _ in range(rng.randint(1, 60)))
        symbols = [tree.vocabulary[c] for c in letters]
        naive = list(symbols)
        while True:
            ranked = [(tree.pairs[p][0], i) for i, p in enumerate(zip(naive, naive[1:])) if p in tree.pairs]
            if not ranked:
                break
            i = min(ranked)[1]
            naive[i : i + 2] = [tree.pairs[naive[i], naive[i + 1]][1]]
        assert tree.merge(symbols) == naive


def test_round_trip_rows(make_docs, odd_texts):
    rows = list(enumerate(odd_texts)) + [(3, "one"), (None, "x")]
    got = bpe.round_trip(make_docs(rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in got) == sorted(
        (i is None, i or 0, " ".join(map(str, expected(t or "")))) for i, t in rows
    )
    digests = {r.doc_id: r for r in bpe.round_trip(make_docs(rows), digests=True).collect()}
    for r in got:
        if r.doc_id != 3:
            assert digests[r.doc_id].ids_sha256 == hashlib.sha256(r.ids.encode()).hexdigest()
            assert digests[r.doc_id].decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.round_trip(make_docs([])).count() == 0


def test_counts_come_from_the_cache(spark, make_docs, odd_texts):
    cache = fresh_path(spark, "cache")
    rows = list(enumerate(odd_texts * 2)) + [(None, "null id"), (None, "one")]
    got = count_tokens(make_docs(rows), cache).collect()
    assert len(got) == len(rows)
    assert all(r.n_tokens == len(expected(r.text or "")) for r in got)
    stored = spark.read.parquet(cache)
    distinct = len({t or "" for _, t in rows})
    assert stored.count() == distinct
    more = make_docs(rows + [(500, "not seen before")])
    assert all(r.n_tokens == len(expected(r.text or "")) for r in count_tokens(more, cache).collect())
    assert spark.read.parquet(cache).count() == distinct + 1
    assert count_tokens(make_docs([]), cache).count() == 0


def test_cached_counts_are_believed_and_versioned(spark, make_docs):
    from wickline.llm.token_counts import CACHE_SCHEMA, tokenizer_digest

    cache = fresh_path(spark, "cache")
    digest = hashlib.sha256(b"known").hexdigest()
    entries = [(digest, tokenizer_digest(tokens.WORD_BPE), 77), (digest, "another version", 5)]
    spark.createDataFrame(entries, CACHE_SCHEMA).write.parquet(cache)
    odd = spark.createDataFrame([(1, "known", 3), (2, "new", 4)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in count_tokens(odd, cache).collect()}
    assert got == {1: 77, 2: len(expected("new"))}


LENGTHS = {
    "any": lambda r: r.randint(1, 100),
    "thirds": lambda r: r.randint(30, 36),
    "quarters": lambda r: r.randint(17, 38),
    "large": lambda r: r.randint(51, 100),
    "full": lambda r: 100,
}


@pytest.mark.parametrize("kind", LENGTHS)
def test_local_search_keeps_all_and_never_needs_more(kind):
    rng = random.Random(8)
    lengths = [LENGTHS[kind](rng) for _ in range(400)]
    start = best_fit(lengths, 100)
    search = LocalSearch(start, lengths, 100)
    before = int((search.fill**2).sum())
    bins = search.run()
    assert sorted(i for b in bins for i in b) == list(range(400))
    assert all(0 < sum(lengths[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= len(start) and int((search.fill**2).sum()) >= before


def test_swaps_empty_a_bin():
    lengths = [60, 30, 50, 40, 20]
    assert len(LocalSearch([[0, 1], [2, 3], [4]], lengths, 100).run()) == 2  # 60 for 50, then 20 fits
    lengths = [30, 25, 20, 50, 40, 35]
    assert len(LocalSearch([[0, 1, 2], [3, 4], [5]], lengths, 100).run()) == 2  # needs two for one
    assert len(pack(lengths, 100)) == 2


def test_packed_documents(make_docs, odd_texts):
    rows = list(enumerate(odd_texts)) + [(1, ""), (None, "x y z")]
    got = pack_documents(make_docs(rows), capacity=64).collect()
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    want = []
    for i, t in rows:
        ids = np.array([*expected(t or ""), 1], "<u4")
        want += [(i, k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=order) == sorted(want, key=order)
    assert pack_documents(make_docs([])).count() == 0


def test_levels_leave_little_room(spark):
    rng = random.Random(1)
    rows = [(i, min(100, int(rng.lognormvariate(2.5, 1)) + 1)) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "row_id long, length long").cache()
    got = pack_pieces(pieces, 100, ["row_id"], group_pieces=40).collect()
    assert sorted(r.row_id for r in got) == list(range(3000))
    least = -(-sum(n for _, n in rows) // 100)
    assert len({r.sequence_id for r in got}) <= least + 2


def test_letters_with_a_mark_are_one_word_each():
    texts = ["Straße STRASSE, strasse. Strasse Straße,", "a.b a.. a., .a , . ß. Ø, ſ, Ÿ ŉ × ª. Į İ. į", "", "x" * 3000 + ".", ". . , Ÿ,"]
    encoder = tokens.ChunkEncoder()
    encoder.encode(texts[:1])
    assert len(encoder.chunks) == 0 and len(encoder.words) == 4
    for _ in range(2):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == [
            encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts
        ]
