"""Likelihood of texts over all segmentations into the pieces of a subword vocabulary."""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickline.llm import tokens
from wickline.llm import words as W
from wickline.llm.bpe import byte_letters
from wickline.llm.scratch import written

LN10 = math.log(10)
CELLS = 400_000
BLOCK_BYTES = 16 << 20
PIECE_BYTES = 2 << 20
WORDS = 2_500
MIN_CLASS_SHARE = 0.01
INNER, FINAL, NOWHERE = -1, -2, -3  # keys beside the bytes in the trie of pieces
PIECE_BITS, WORD_BITS = 20, 15  # of a packed edge: end, word, length of the piece, piece
LENGTH_BITS = PIECE_BITS + 8


# ------------------------------------------------------------------------ the lattice


class Lattice:
    """Edges and recursions for batches of words, in byte letters. Pieces that end a
    word are apart from those that go on; every byte is a piece of both kinds, so
    every word has a segmentation."""

    def __init__(self, name: str = tokens.WORD_BPE):
        spec = json.loads(Path(public_tokenizers.path(name)).read_text(encoding="utf-8"))["model"]
        suffix = spec["end_of_word_suffix"]
        self.size = max(spec["vocab"].values()) + 1
        self.final = {p.removesuffix(suffix): i for p, i in spec["vocab"].items() if p.endswith(suffix)}
        self.inner = {p: i for p, i in spec["vocab"].items() if not p.endswith(suffix)}
        self.letters = byte_letters()
        of_letter = {letter: b for b, letter in enumerate(self.letters)}
        # A trie over bytes: a node's children by byte, and its pieces by INNER and FINAL.
        self.root: dict[int, dict | int] = {}
        for kind, pieces in ((INNER, self.inner), (FINAL, self.final)):
            for letters, i in pieces.items():
                node = self.root
                for c in letters:
                    node = node.setdefault(of_letter.get(c, NOWHERE), {})
                node[kind] = i

    def prior(self) -> np.ndarray:
        """Log probabilities before any text is seen: vocabularies of this kind are
        sorted by how early, so how often, a piece was needed; the n-th has 1 / n."""
        weights = 1.0 / np.arange(1, self.size + 1)
        return np.log(weights / weights.sum())[:, None]

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(word, from, to, piece) of all pieces in all words, by end and word."""
        root, out = self.root, []
        for w, word in enumerate(words):
            data = word.encode("utf-8", "surrogatepass")
            last = len(data) - 1
            for i in range(len(data)):
                node = root
                for j in range(i, last + 1):
                    node = node.get(data[j])
                    if node is None:
                        break
                    piece = node.get(FINAL if j == last else INNER)
                    if piece is not None:
                        out.append(((j + 1) << WORD_BITS | w) << LENGTH_BITS | (j + 1 - i) << PIECE_BITS | piece)
        # Numbers that sort by end and word; too wide for 64 bits only if a word has millions of bytes.
        if out and max(out) >= 1 << 63:
            key = np.array(sorted(out), object)
        else:
            key = np.sort(np.array(out, np.int64))
        place, rest = key >> LENGTH_BITS, key & ((1 << LENGTH_BITS) - 1)
        columns = place & ((1 << WORD_BITS) - 1), place >> WORD_BITS, rest >> PIECE_BITS, rest & ((1 << PIECE_BITS) - 1)
        word, to, length, piece = (c.astype(np.int64) for c in columns)
        return word, to - length, to, piece

    @staticmethod
    def _batches(words: list[str]) -> Iterator[np.ndarray]:
        """Numbers of words of like length, so that the tables below stay small."""
        size = np.array([len(w.encode("utf-8", "surrogatepass")) for w in words])
        order = np.argsort(size, kind="stable")
        start = 0
        while start < len(order):
            end = start + 1
            while end < len(order) and (end - start + 1) * (size[order[end]] + 1) <= CELLS and end - start < 20_000:
                end += 1
            yield order[start:end]
            start = end

    @staticmethod
    def _steps(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            if b > a:
                yield int(keys[a]), slice(a, b)

    def _forward(self, n: int, edges: tuple, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log weight of all ways from a word's begin to each place; the last place."""
        word, start, to, piece = edges
        table = np.full((int(to.max()) + 1, n, scores.shape[1]), -np.inf)
        table[0] = 0.0
        last = np.zeros(n, np.int64)
        for j, part in self._steps(to):
            w = word[part]
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            table[j, w[first]] = np.logaddexp.reduceat(table[start[part], w] + scores[piece[part]], first, axis=0)
            last[w] = j
        return table, last

    def log_probs(self, words: list[str], scores: np.ndarray) -> np.ndarray:
        """Natural log of each word's marginal probability, one column per column of ``scores``."""
        out = np.full((len(words), scores.shape[1]), -np.inf)
        for numbers in self._batches(words):
            edges = self.edges([words[i] for i in numbers.tolist()])
            table, last = self._forward(len(numbers), edges, scores)
            out[numbers] = table[last, np.arange(len(numbers))]
        return out

    def expected(self, words: list[str], scores: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in the words, weighted per column of ``weights``,
        by a forward and a backward recursion under one column of scores."""
        out = np.zeros((self.size, weights.shape[1]))
        for numbers in self._batches(words):
            edges = self.edges([words[i] for i in numbers.tolist()])
            word, start, to, piece = edges
            table, last = self._forward(len(numbers), edges, scores)
            total = table[last, np.arange(len(numbers)), 0]
            back = np.full(table.shape[:2], -np.inf)
            back[last, np.arange(len(numbers))] = 0.0
            order = np.lexsort((word, -start))
            for i, part in self._steps(start[order]):
                chosen = order[part]
                w = word[chosen]
                first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                back[i, w[first]] = np.logaddexp.reduceat(scores[piece[chosen], 0] + back[to[chosen], w], first)
            share = np.exp(table[start, word, 0] + scores[piece, 0] + back[to, word] - total[word])
            own = weights[numbers]
            for k in range(weights.shape[1]):
                out[:, k] += np.bincount(piece, share * own[word, k], minlength=self.size)
        return out


@functools.cache
def lattice(name: str = tokens.WORD_BPE) -> Lattice:
    return Lattice(name)


# ------------------------------------------------------------------------- the model


@dataclass(frozen=True)
class LatticeModel:
    """What scoring needs: per class its share of the training documents, its tokens
    (ends included), ends, distinct words, and log probabilities of the pieces.

    A text is a class, then words and an end. In a class a word is a known word with
    its discounted count, or spelt by the lattice with the mass that the discount
    frees; both ways are summed. Classes are summed as well: what is scored is the
    text alone."""

    classes: list[str]
    docs: np.ndarray
    tokens: np.ndarray
    distinct: np.ndarray
    scores: np.ndarray
    discount: float = 0.6

    def word_log10(self, counts: np.ndarray, spelt: np.ndarray) -> np.ndarray:
        """log10 probability per word (row) and class, from the classes' counts and
        the lattice's log probabilities. A class without training spells all words."""
        known = np.maximum(counts - self.discount, 0.0) / np.maximum(self.tokens, 1)
        free = np.where(self.tokens > 0, self.discount * self.distinct / np.maximum(self.tokens, 1), 0.5)
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(known), np.log(free) + spelt) / LN10

    def end_log10(self) -> np.ndarray:
        return np.log10(np.where(self.tokens > 0, self.docs / np.maximum(self.tokens, 1), 0.5))

    def class_log10(self) -> np.ndarray:
        total = self.docs.sum()
        with np.errstate(divide="ignore"):
            return np.log10(self.docs / total) if total else np.full(len(self.docs), -math.log10(len(self.docs)))


def _word_counts(n_classes: int):
    """(word, class, n) of a batch; words of held-out documents count 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in W.pieces(batch, "text", PIECE_BYTES):
                found = W.words(pc.ascii_lower(texts))
                of = part.column(part.schema.get_field_index("class")).to_numpy(zero_copy_only=False)
                key = found.codes.astype(np.int64) * (n_classes + 1) + of[found.owner]
                pairs, n = np.unique(key, return_counts=True)
                code, cls = np.divmod(pairs, n_classes + 1)
                n = np.where(cls == n_classes, 0, n)
                names = found.values.cast(pa.string()).take(pa.array(code))
                yield pa.RecordBatch.from_arrays([names, pa.array(cls, pa.int32()), pa.array(n, pa.int64())], names=["word", "class", "n"])

    return run


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ``WORDS``: a word has many edges."""
    for batch in batches:
        for start in range(0, batch.num_rows, WORDS):
            yield batch.slice(start, WORDS)


def _expectation(name: str, n_classes: int):
    """Expected pieces of the words, each distinct word of a class once: the lattice
    is for words that are rare or new, so frequent ones mustn't rule it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = lattice(name)
        total = np.zeros((grid.size, n_classes))
        for batch in _few(batches):
            counts = batch.column(1).flatten().to_numpy().reshape(-1, n_classes)
            total += grid.expected(batch.column(0).to_pylist(), grid.prior(), (counts > 0).astype(float))
        piece, cls = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece, pa.int32()), pa.array(cls, pa.int32()), pa.array(total[piece, cls])], names=["piece", "class", "uses"]
        )

    return run


def _spell(name: str, shared_model):
    """(word, c, scores per class as 32-bit floats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, model = lattice(name), shared_model.value
        for batch in _few(batches):
            counts = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            spelt = grid.log_probs(batch.column(0).to_pylist(), model.scores)
            scores = model.word_log10(counts, spelt).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, scores.size + 1, scores.shape[1]), pa.int32()), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.sum(axis=1), pa.int64()), lists], names=["word", "c", "scores"])

    return run


def _block_words(docs: pa.Table) -> pa.Table:
    """(block, word) of the distinct words of one block."""
    parts = [W.words(pc.ascii_lower(texts)).values.cast(pa.string()) for batch in docs.to_batches() for _, texts in W.pieces(batch, "text", PIECE_BYTES)]
    words = pa.chunked_array(parts, pa.string()).unique()
    block = pa.array(np.full(len(words), docs.column("block")[0].as_py()), pa.int32())
    return pa.table([block, words], names=["block", "word"])


def _score_block(shared_model, all_tokens: int, all_distinct: int, end_count: int):
    """Documents and words of one block to one row per document."""
    floor = all_tokens + 0.5 * (all_distinct + 1)

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        model = shared_model.value
        k = len(model.classes)
        names = words.column("word").combine_chunks()
        count = words.column("c").to_numpy()
        scores = words.column("scores").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, k)
        out = []
        for batch in docs.to_batches():
            for part, texts in W.pieces(batch, "text", PIECE_BYTES):
                found = W.words(pc.ascii_lower(texts))
                at = pc.index_in(found.values.cast(names.type), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
                c = count[at][found.codes]
                base = np.bincount(found.owner, np.log10((c + 0.5) / floor), minlength=found.n) + math.log10((end_count + 0.5) / floor)
                own = scores[at]
                by_class = np.stack([np.bincount(found.owner, own[:, i][found.codes], minlength=found.n) for i in range(k)], axis=1)
                by_class += model.end_log10() + model.class_log10()
                score = np.logaddexp.reduce(by_class * LN10, axis=1) / LN10
                known = found.per_text((c > 0).astype(float)) + (end_count > 0)
                out.append(
                    pa.RecordBatch.from_arrays(
                        [
                            part.column(part.schema.get_field_index("id")),
                            part.column(part.schema.get_field_index("held_out")),
                            pa.array(found.per_text() + 1),
                            pa.array(known),
                            pa.array(np.full(found.n, all_tokens)),
                            pa.array(base),
                            pa.array(score),
                        ],
                        names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                    )
                )
        return pa.Table.from_batches(out)

    return run


def held_out(id_col: str) -> Column:
    """Documents that the model doesn't learn from; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % 5 == 1


def score_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    class_col: str = "lang",
    tokenizer: str = tokens.WORD_BPE,
    discount: float = 0.6,
) -> DataFrame:
    """Per row of ``df``: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score``, log10 probabilities of the whole text.

    Learns from the rows that aren't held out. The corpus gives, by shuffles, counts of
    all words per class and the expected uses of the vocabulary's pieces. Classes are
    the values of ``class_col`` with at least ``MIN_CLASS_SHARE`` of the training rows,
    so a hundred at most; the others are one class together. Texts are scored in
    blocks of about ``BLOCK_BYTES``: a block gets the scores of its distinct words,
    so a frequent word is sent once per block.

    Words are runs without ASCII white space, A-Z lowered; each text has one end token
    more. Null texts are empty: their score is that of an end alone. A null class is a
    class. Repeated rows count and are scored each. Without training rows the lattice
    alone scores, under its prior. An empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(f"`{id_col}`").alias("id"),
        held_out(id_col).alias("held_out"),
        F.coalesce(F.col(f"`{class_col}`").cast("string"), F.lit("")).alias("label"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    trained = rows.filter("not held_out")
    least = trained.count() * MIN_CLASS_SHARE
    classes = sorted(r.label for r in trained.groupBy("label").count().filter(F.col("count") >= least).collect())
    labels = [*classes, None] if trained.filter(~F.col("label").isin(classes)).limit(1).count() or not classes else classes
    k = len(labels)  # None, the last, is for the values that are too rare
    number = F.lit(k - 1)
    for i, label in enumerate(classes):
        number = F.when(F.col("label") == label, F.lit(i)).otherwise(number)
    number = F.when(F.col("held_out"), F.lit(k)).otherwise(number).cast("int")
    sizes = rows.groupBy(number.alias("class")).agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    docs = np.zeros(k + 1)
    for r in sizes:
        docs[r["class"]] = r.docs
    docs = docs[:k]
    blocks = max(1, -(-sum(r.bytes for r in sizes) // BLOCK_BYTES))

    counted = rows.select(number.alias("class"), "text").mapInArrow(_word_counts(k), "word string, class int, n long")
    per_class = [F.sum(F.when(F.col("class") == i, F.col("n")).otherwise(0)) for i in range(k)]
    vocabulary = written(counted.groupBy("word").agg(F.array(*per_class).alias("counts")), "words")
    one = F.col("counts")
    sums = vocabulary.agg(
        *[F.sum(one[i]).alias(f"n{i}") for i in range(k)],
        *[F.count_if(one[i] > 0).alias(f"v{i}") for i in range(k)],
        F.count_if(F.aggregate(one, F.lit(0).cast("long"), lambda a, b: a + b) > 0).alias("v"),
    ).first()
    in_class = np.array([sums[f"n{i}"] or 0 for i in range(k)], float)
    train_docs = int(docs.sum())
    all_tokens, all_distinct = int(in_class.sum()) + train_docs, sums["v"] + (train_docs > 0)

    grid = lattice(tokenizer)
    used = vocabulary.filter(F.exists("counts", lambda c: c > 0)).mapInArrow(_expectation(tokenizer, k), "piece int, class int, uses double")
    uses = np.zeros((grid.size, k))
    for r in used.groupBy("piece", "class").agg(F.sum("uses").alias("uses")).toLocalIterator():
        uses[r.piece, r["class"]] = r.uses
    uses += np.exp(grid.prior()) * 100  # pieces that were never seen keep a share
    model = LatticeModel(
        [str(label) for label in labels],
        docs,
        in_class + docs,
        np.array([sums[f"v{i}"] or 0 for i in range(k)], float),
        np.log(uses / uses.sum(axis=0)),
        discount,
    )
    shared = spark.sparkContext.broadcast(model)

    scored = vocabulary.mapInArrow(_spell(tokenizer, shared), "word string, c long, scores array<float>")
    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")
    # Both readers take the same columns by the same key, so the texts move once.
    placed = rows.select(block.alias("block"), "id", "held_out", "text").groupBy("block")
    wanted = placed.applyInArrow(_block_words, "block int, word string")
    lines = wanted.join(scored, "word").select("block", "word", "c", "scores")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    run = _score_block(shared, all_tokens, all_distinct, train_docs)
    return placed.cogroup(lines.groupBy("block")).applyInArrow(run, schema).withColumnRenamed("id", id_col)
