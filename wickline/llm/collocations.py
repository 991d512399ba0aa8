"""Collocations of words: phrases counted in burst tries, those of frequent pairs only."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickline.llm import words as W
from wickline.llm.scratch import written

ID_BITS = 19
BLOCK = 64
#: Places of the words in a 63-bit key; of the first word only its place in its block.
SHIFTS = (3 * ID_BITS, 2 * ID_BITS, ID_BITS, 0)
BREAK = b"\n"
# A-Z lowered, tabs as spaces, all marks that part pieces as line feeds.
NORMAL = bytes(
    10 if chr(b) in ".,;:!?" or 10 <= b <= 13 else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
COUNT_BYTES = 4 << 20
TABLE_BITS = 27
SLOTS = 256
RUN_ROWS = 50_000
RUN_KEYS = 2_000_000
#: Bits of a hash that runs keep: they only say what may be common, and shorter ones move less.
KEPT = np.uint64((1 << 64) - (1 << 24))


@dataclass(frozen=True)
class Mining:
    """``longest``: words of the longest phrase; ``support``: its least count;
    ``contained``: a phrase goes when a longer one that holds it has at least so many
    of a hundred of its occurrences; ``top``: phrases reported per group.

    ``burst``: entries at which a container becomes a node; ``held``: entries a task
    holds before it spills. Both change the cost only."""

    longest: int = 4
    support: int = 30
    contained: int = 80
    top: int = 2000
    burst: int = 4096
    held: int = 400_000


# ------------------------------------------------------------------ words of a block


def block_words(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """(codes, values) of the words of the texts in order, and of a line feed wherever a
    piece ends, so that no phrase runs over it."""
    blob = BREAK.join(texts).translate(NORMAL).replace(BREAK, b" " + BREAK + b" ")
    flat = pc.split_pattern(pa.array([blob], pa.large_binary()), b" ").flatten()
    coded = flat.filter(pc.greater(pc.binary_length(flat), 0)).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def word_hashes(words: list[bytes], group: str) -> np.ndarray:
    """64-bit hashes of a group's words; 0 for the end of a piece."""
    seed = W.content_hashes(pa.array([group]))[0]
    hashes = W.mix(W.content_hashes(pa.array(words, pa.binary())) ^ seed) if words else np.zeros(0, np.uint64)
    ends = np.fromiter((w == BREAK for w in words), bool, len(words))
    return np.where(ends, np.uint64(0), np.maximum(hashes, np.uint64(1)))


def phrase_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    return W.windows(hashes, np.zeros(len(hashes), np.int8), width)[1]


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """The texts of a block, group by group."""
    for batch in batches:
        for part, texts in W.pieces(batch, "text", COUNT_BYTES):
            raw = texts.cast(pa.large_binary())
            coded = part.column(part.schema.get_field_index("group")).dictionary_encode()
            which = coded.indices.to_numpy(zero_copy_only=False)
            for k, group in enumerate(coded.dictionary.to_pylist()):
                yield group, raw.filter(pa.array(which == k)).to_pylist()


def phrase_places(codes: np.ndarray, words: list[bytes], hashes: np.ndarray | None, widths: Sequence[int], common: Sequence[Common] | None) -> list[np.ndarray]:
    """Per width where phrases begin that lie in one piece and may be common: they, or
    all their parts of the widths of the bit tables, are in them."""
    real = np.fromiter((w != BREAK for w in words), bool, len(words))[codes]
    longest = max(widths)
    held = {width: table.holds(phrase_hashes(hashes, width)) for table in common or () for width in table.widths if width <= longest}
    out = []
    for width in widths:
        n = max(len(codes) - width + 1, 0)
        inside = real[:n].copy()
        for k in range(1, width):
            inside &= real[k : k + n]
        for part, known in held.items():
            for k in range(width - part + 1):
                inside &= known[k : k + n]
        out.append(np.flatnonzero(inside))
    return out


# ---------------------------------------------------------- which phrases may be common


@dataclass(frozen=True)
class Common:
    """A bit table of hashes of phrases of so many words: what isn't in it isn't common."""

    widths: tuple[int, ...]
    bits: int
    table: np.ndarray

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> np.uint64(64 - self.bits)
        return (self.table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _hashes_of(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, phrases = (c.to_pylist() for c in batch.columns)
            by_group: dict[str, list[bytes]] = {}
            for group, phrase in zip(groups, phrases):
                by_group.setdefault(group, []).extend(phrase.split(b" "))
            for group, words in by_group.items():
                found = phrase_hashes(word_hashes(words, group), width)[::width]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["hash"])

    return run


def _slots(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            bit = np.uint64(1) << (slot & np.uint64(63))
            columns = [pa.array((slot >> np.uint64(6)).astype(np.int64)), pa.array(bit.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "mask"])

    return run


def bit_table(hashes: DataFrame, widths: Sequence[int]) -> Common:
    """The bit table of a written table of hashes: 16 bits each, 16 MB at most. Beyond
    that more passes the table and is counted; the counts are exact either way."""
    bits = min(max(int(16 * hashes.count()).bit_length(), 12), TABLE_BITS)
    slots = hashes.mapInArrow(_slots(bits), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    table = np.zeros(1 << (bits - 6), np.uint64)
    for batch in slots.toArrow().to_batches():
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return Common(tuple(widths), bits, table)


def common_phrases(phrases: DataFrame, width: int) -> Common:
    """The bit table of ``phrases`` (group, phrase) of ``width`` words."""
    hashes = phrases.select("group", F.col("phrase").cast("binary")).mapInArrow(_hashes_of(width), "hash long")
    return bit_table(written(hashes, "hashes"), [width])


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their counts added up."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _packed(key: np.ndarray, n: np.ndarray) -> bytes:
    """A sorted run: differences of its keys and its counts, byte by byte."""
    columns = [np.diff(key, prepend=np.uint64(0)), n.astype(np.uint64)]
    return zlib.compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns), 1)


def _unpacked(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(run), np.uint8).reshape(2, 8, -1)
    difference, n = (np.ascontiguousarray(c.T).view(np.uint64).ravel() for c in both)
    return np.cumsum(difference, dtype=np.uint64), n


def _hash_runs(widths: Sequence[int], parts: int, shared_common):
    """Sorted runs of a task's phrase hashes and their counts, cut by ranges of hashes."""

    def spill(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        of = (key // np.uint64((1 << 64) // parts)).astype(np.int64)
        cuts = [*np.flatnonzero(np.diff(of, prepend=-1)).tolist(), len(of)]
        runs = [_packed(key[a:b], n[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        columns = [pa.array(of[cuts[:-1]], pa.int64()), pa.array(runs, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for group, texts in _by_group(batches):
            codes, values = block_words(texts)
            words = values.to_pylist()
            hashes = word_hashes(words, group)[codes]
            places = phrase_places(codes, words, hashes, widths, shared_common.value)
            found = [phrase_hashes(hashes, width)[inside] for width, inside in zip(widths, places) if len(inside)]
            if not found:
                continue
            key, n = np.unique(np.concatenate(found) & KEPT, return_counts=True)
            keys.append(key)
            counts.append(n)
            held += len(key)
            if held > RUN_KEYS:
                keys, counts = ([x] for x in _added(keys, counts))
                held = len(keys[0])
                if held > RUN_KEYS // 2:
                    yield spill(keys[0], counts[0])
                    keys, counts, held = [], [], 0
        if held:
            yield spill(*_added(keys, counts))

    return run


def _frequent(support: int):
    """Rows sorted by part: the hashes whose counts over all runs reach the support."""

    def found(runs: list[bytes]) -> pa.RecordBatch:
        key, n = _added(*zip(*map(_unpacked, runs)))
        return pa.RecordBatch.from_arrays([pa.array(key[n >= support].view(np.int64))], names=["hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, runs = None, []
        for batch in batches:
            for of, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if of != part and runs:
                    yield found(runs)
                    runs = []
                part = of
                runs.append(blob)
        if runs:
            yield found(runs)

    return run


def frequent_hashes(texts: DataFrame, widths: Sequence[int], rule: Mining, common: Sequence[Common], n_words: int) -> Common:
    """The bit table of the phrases of so many words that may have the support, by
    counting 40 bits of their hashes: phrases that share them add up, so none is missed.
    A part of the runs holds ``RUN_KEYS`` occurrences or so, by the words of the corpus."""
    shared = texts.sparkSession.sparkContext.broadcast(common)
    parts = max(16, -(-n_words * len(widths) // RUN_KEYS))
    runs = texts.mapInArrow(_hash_runs(widths, parts, shared), "part long, run binary")
    merged = runs.repartition("part").sortWithinPartitions("part").mapInArrow(_frequent(rule.support), "hash long")
    return bit_table(written(merged, "hashes"), widths)


# ----------------------------------------------------------------------- counting


class Node(dict):
    """Children by their part of the key."""


class BurstTrie:
    """Counts of phrases of up to four word numbers, under a shallow trie.

    At first a block of 64 first words shares one hash container; when that outgrows
    ``burst`` it becomes a node with a container per first word, and such a container in
    turn a node with one per second word. A key is the first word's place in its block
    and the other words, packed."""

    def __init__(self, burst: int, width: int):
        self.burst, self.width, self.deepest = burst, width, min(width, 3) - 1
        self.roots = Node()
        self.sizes: Counter = Counter()
        self.entries = 0

    def add(self, words: list[np.ndarray]) -> None:
        """Counts phrases, given by their first words, their second words and so on."""
        key = (words[0] & (BLOCK - 1)) << SHIFTS[0]
        for w, shift in zip(words[1:], SHIFTS[1:]):
            key |= w << shift
        root = words[0] // BLOCK
        order = np.lexsort((key, root))
        root, key = root[order], key[order]
        cuts = [*np.flatnonzero(np.diff(root, prepend=-1)).tolist(), len(root)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            block = int(root[a])
            grown = self._count(self.roots, block, key[a:b], 0)
            self.entries += grown
            self.sizes[block] += grown

    def _count(self, parent: Node, name: int, key: np.ndarray, level: int) -> int:
        """Counts sorted keys below a child of ``parent``; gives the number of new ones."""
        node = parent.get(name)
        if node is None:
            node = parent[name] = Counter()
        if isinstance(node, Node):
            part = key >> SHIFTS[level]
            cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
            return sum(self._count(node, int(part[a]), key[a:b], level + 1) for a, b in zip(cuts[:-1], cuts[1:]))
        before = len(node)
        node.update(key.tolist())
        after = len(node)
        if after > self.burst and level < self.deepest:
            parent[name] = self._burst(node, level)
        return after - before

    @staticmethod
    def _burst(container: Counter, level: int) -> Node:
        node = Node()
        for key, n in container.items():
            node.setdefault(key >> SHIFTS[level], Counter())[key] = n
        return node

    def _leaves(self, node: Node | Counter) -> Iterator[Counter]:
        if isinstance(node, Node):
            for child in node.values():
                yield from self._leaves(child)
        else:
            yield node

    def spill(self, down_to: int) -> tuple[list[np.ndarray], np.ndarray]:
        """(words by their places, counts) of whole subtrees, the largest ones, so that
        ``down_to`` entries are left; sorted by word numbers."""
        blocks, leaves = [], []
        for block, size in self.sizes.most_common():
            if self.entries <= down_to:
                break
            mine = list(self._leaves(self.roots.pop(block)))
            del self.sizes[block]
            self.entries -= size
            blocks += [block] * len(mine)
            leaves += mine
        lengths = list(map(len, leaves))
        total = sum(lengths)
        root = np.repeat(np.array(blocks, np.int64), lengths)
        key = np.fromiter(chain.from_iterable(leaves), np.int64, total)
        n = np.fromiter(chain.from_iterable(leaf.values() for leaf in leaves), np.int64, total)
        order = np.lexsort((key, root))
        root, key, n = root[order], key[order], n[order]
        words = [root * BLOCK + (key >> SHIFTS[0])] + [key >> shift & ((1 << ID_BITS) - 1) for shift in SHIFTS[1:]]
        return words, n


class TaskCounter:
    """One task's words, numbered as they come, and a trie of its phrases per width."""

    def __init__(self, widths: Sequence[int], rule: Mining, common: Sequence[Common] | None):
        self.widths, self.rule, self.common = widths, rule, common
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, dict[bytes, int]] = {}
        self.words: list[tuple[str, bytes]] = [("", b"")]  # number 0 is no word
        self.tries = [BurstTrie(self.rule.burst, width) for width in self.widths]

    def _numbers(self, group: str, words: list[bytes], wanted: np.ndarray) -> np.ndarray:
        ids, out = self.ids.setdefault(group, {}), np.zeros(len(words), np.int64)
        for k in np.flatnonzero(wanted).tolist():
            word = words[k]
            number = ids.get(word)
            if number is None:
                number = ids[word] = len(self.words)
                self.words.append((group, word))
            out[k] = number
        return out

    def add(self, group: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        codes, values = block_words(texts)
        words = values.to_pylist()
        if len(self.words) + len(words) >= 1 << ID_BITS:
            yield from self.finish()
        hashes = word_hashes(words, group)[codes] if self.common else None
        places = phrase_places(codes, words, hashes, self.widths, self.common)
        used = np.zeros(len(words), bool)
        for width, at in zip(self.widths, places):
            for k in range(width):
                used[codes[at + k]] = True
        numbers = self._numbers(group, words, used)[codes]
        for width, at, trie in zip(self.widths, places, self.tries):
            if len(at):
                trie.add([numbers[at + k] for k in range(width)])
        if sum(trie.entries for trie in self.tries) > self.rule.held:
            for trie in self.tries:
                yield from self._runs(trie, trie.entries // 2)

    def _runs(self, trie: BurstTrie, down_to: int) -> Iterator[pa.RecordBatch]:
        """Subtrees as a run of rows."""
        word, n = trie.spill(down_to)
        if not len(n):
            return
        groups, words = zip(*self.words)
        words = pa.array(words, pa.binary())
        names = [words.take(pa.array(w)) for w in word[: trie.width]]
        rest = pc.binary_join_element_wise(*names[1:], b" ") if names[1:] else pa.array([b""] * len(n), pa.binary())
        columns = [pa.array(groups).take(pa.array(word[0])), names[0], rest, pa.array(n)]
        run = pa.RecordBatch.from_arrays(columns, names=["group", "first", "rest", "n"])
        yield from (run.slice(k, RUN_ROWS) for k in range(0, len(n), RUN_ROWS))

    def finish(self) -> Iterator[pa.RecordBatch]:
        for trie in self.tries:
            yield from self._runs(trie, 0)
        self.clear()


def _counter(widths: Sequence[int], rule: Mining, shared_common):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TaskCounter(widths, rule, shared_common.value)
        for group, texts in _by_group(batches):
            yield from counter.add(group, texts)
        yield from counter.finish()

    return count


def count_phrases(texts: DataFrame, widths: Sequence[int], rule: Mining, common: Sequence[Common]) -> DataFrame:
    """(group, phrase, a) of the phrases of so many words that may be common, or whose
    parts may. The runs that tasks spill are dealt by group and first word, the
    prefix of their subtree, in ``SLOTS`` parts by what follows it, so that a frequent
    first word is spread; Spark merges the runs of a part and adds up equal phrases."""
    shared = texts.sparkSession.sparkContext.broadcast(common)
    runs = texts.mapInArrow(_counter(widths, rule, shared), "group string, first binary, rest binary, n long")
    slot = F.pmod(F.xxhash64("rest"), F.lit(SLOTS)).alias("slot")
    merged = runs.select("group", "first", slot, "rest", "n").repartition("group", "first", "slot")
    counted = merged.groupBy("group", "first", "slot", "rest").agg(F.sum("n").alias("a"))
    tail = F.when(F.length("rest") > 0, F.concat(F.lit(" "), F.col("rest").cast("string"))).otherwise(F.lit(""))
    return counted.select("group", F.concat(F.col("first").cast("string"), tail).alias("phrase"), "a")


# ------------------------------------------------------------------- scores and choice


def _part(start: Column, n: Column) -> Column:
    return F.array_join(F.slice("words", start, n), " ")


def _scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates with the l, r and score of their lowest-scoring cut, the first of
    those that tie. Decimals keep the products exact."""
    size = F.size("words")
    cuts = (
        candidates.withColumn("words", F.split("phrase", " "))
        .withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
        .select("group", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, size - F.col("k")).alias("right"))
    )
    for side, name in (("left", "l"), ("right", "r")):
        known = counts.select("group", F.col("phrase").alias(side), F.col("a").alias(name))
        cuts = cuts.join(known, ["group", side])
    score = F.expr("cast((cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("group", "phrase", "a").agg(lowest).select("group", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _uncontained(candidates: DataFrame, percent: int) -> DataFrame:
    """Candidates that no longer one holds often enough."""
    size = F.size("words")
    inner = (
        candidates.withColumn("words", F.split("phrase", " "))
        .filter(size > 2)
        .withColumn("n", F.explode(F.sequence(F.lit(2), size - 1)))
        .withColumn("at", F.explode(F.sequence(F.lit(1), size - F.col("n") + 1)))
        .select("group", _part(F.col("at"), F.col("n")).alias("phrase"), "a")
        .groupBy("group", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    share = F.lit(100).cast("decimal(3,0)") * F.col("longer").cast("decimal(20,0)")
    gone = share >= F.lit(percent).cast("decimal(3,0)") * F.col("a").cast("decimal(20,0)")
    return candidates.join(inner, ["group", "phrase"], "left").filter(F.col("longer").isNull() | ~gone).select("group", "phrase")


def collocations(df: DataFrame, rule: Mining = Mining(), text_col: str = "text", group_col: str = "lang", unknown: str = "und") -> DataFrame:
    """Per group its ``top`` phrases of 2 to ``longest`` (at most 4) words: ``rank``,
    ``phrase``, ``a`` (occurrences), ``l`` and ``r`` (those of the two parts at the cut
    that scores lowest), ``n`` (words of the group) and ``score``.

    Texts have A-Z lowered and are cut into pieces at ``.,;:!?`` and line ends, pieces
    into words at blanks and tabs. First the words are
    counted, then the hashes of pairs of frequent words, in sorted runs that are merged
    per range, then in the same way those of longer phrases whose pairs are frequent.
    Phrases are counted by name only if their own hash and those of all their parts are
    frequent, as no other can be.
    A task counts in a trie with burst containers, which spills whole subtrees as runs
    sorted by the task's word numbers when it is full; runs of a prefix meet in one place
    and are added up there, by Spark's aggregation.

    Null texts are empty; a null group is ``unknown``. Repeated rows count each. Equal
    scores are ordered by count, then by the bytes of the phrase. An empty table, or one
    without a frequent phrase, gives an empty result. A block holds at most 4 MB of
    texts, or one longer text whole; other columns aren't looked at.
    """
    if not 2 <= rule.longest <= 4:
        raise ValueError("longest is 2, 3 or 4")
    group = F.coalesce(F.col(f"`{group_col}`").cast("string"), F.lit(unknown))
    texts = df.select(group.alias("group"), F.col(f"`{text_col}`").alias("text"))
    words = written(count_phrases(texts, [1], rule, []), "words")
    totals = words.groupBy("group").agg(F.sum("a").alias("n"))
    n_words = words.agg(F.sum("a")).first()[0] or 0
    frequent = words.filter(F.col("a") >= rule.support)
    known = [frequent_hashes(texts, [2], rule, [common_phrases(frequent, 1)], n_words)]
    if rule.longest > 2:
        known.append(frequent_hashes(texts, range(3, rule.longest + 1), rule, known, n_words))
    phrases = count_phrases(texts, range(2, rule.longest + 1), rule, known)
    candidates = written(phrases.filter(F.col("a") >= rule.support), "phrases")
    scored = _scored(candidates, frequent.union(candidates))
    scored = scored.join(_uncontained(candidates, rule.contained), ["group", "phrase"])
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for key in (["group", "slot"], ["group"]):
        place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
        scored = scored.withColumn("slot", F.pmod(F.xxhash64("phrase"), F.lit(64)))
        scored = scored.withColumn("rank", place.cast("long")).filter(F.col("rank") <= rule.top)
    chosen = scored.join(totals, "group")
    return chosen.select(F.col("group").alias(group_col), "rank", "phrase", "a", "l", "r", "n", "score")
