"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickline.llm import tokens
from wickline.llm import words as W

PLACE_BITS = 32
PLACE = (1 << PLACE_BITS) - 1
NEVER = 1 << 62
WORD_ENTRIES = 800_000
CHUNK_ENTRIES = 250_000
ENCODE_BYTES = 2 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else the
    next letter from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class SegmentTreeBPE:
    """Merges of one vocabulary. Leaf i holds (rank of the pair that begins at symbol
    i, i) as one number, an inner node the smaller of its two; so the root is the
    leftmost pair of the lowest rank. A merge changes three leaves and their
    ancestors."""

    def __init__(self, name: str = tokens.WORD_BPE):
        spec = json.loads(Path(public_tokenizers.path(name)).read_text(encoding="utf-8"))
        self.vocabulary: dict[str, int] = spec["model"]["vocab"]
        self.suffix: str = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            v = self.vocabulary
            self.pairs.setdefault((v[a], v[b]), (rank, v[a + b]))
        self.names = {i: t for t, i in (self.vocabulary | self.special).items()}
        self.letters = byte_letters()

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge until no adjacent pair has a rank."""
        n = len(symbols)
        if n < 2:
            return symbols
        pairs = self.pairs
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [NEVER] * (2 * size)
        for i in range(n - 1):
            found = pairs.get((symbols[i], symbols[i + 1]))
            if found:
                tree[size + i] = found[0] << PLACE_BITS | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        if tree[1] == NEVER:
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    return
                tree[k] = low
                k >>= 1

        def rank(i: int) -> int:
            j = after[i]
            found = pairs.get((symbols[i], symbols[j])) if j < n else None
            return found[0] << PLACE_BITS | i if found else NEVER

        while tree[1] != NEVER:
            i = tree[1] & PLACE
            j = after[i]
            symbols[i] = pairs[symbols[i], symbols[j]][1]
            symbols[j] = -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if j < n - 1:
                put(j, NEVER)
            if i < n - 1:
                put(i, rank(i))
            if before[i] >= 0:
                put(before[i], rank(before[i]))
        return [s for s in symbols if s >= 0]

    def word(self, letters: str) -> list[int]:
        """Ids of a word given in byte letters."""
        v = self.vocabulary
        return self.merge([*(v[c] for c in letters[:-1]), v[letters[-1] + self.suffix]])

    def decode(self, ids: list[int]) -> str:
        """The library's text of ids for a file without a decoder: tokens joined by a space."""
        return " ".join(map(self.names.__getitem__, ids))


class CachedBPE:
    """Encodes and decodes whole texts; remembers words, and for a shorter time the
    chunks between white space, which are words with their capitals and punctuation."""

    def __init__(self, name: str = tokens.WORD_BPE, words: int = WORD_ENTRIES, chunks: int = CHUNK_ENTRIES):
        self.bpe = SegmentTreeBPE(name)
        self.library = tokens.load(name)
        self.max_words, self.max_chunks = words, chunks
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.bpe.special, key=len, reverse=True))) + ")")
        self.words: dict[str, tuple[int, ...]] = {}
        self.ids: dict[str, str] = {}
        self.texts: dict[str, str] = {}

    def _learn(self, word: str, letters: str) -> tuple[int, ...]:
        if len(self.words) >= self.max_words:
            self.words.clear()
        found = self.words[word] = tuple(self.bpe.word(letters))
        return found

    def _piece(self, text: str) -> list[int]:
        """Text without special strings."""
        out: list[int] = []
        known = self.words.get
        words = tokens.plain_words(text)
        if words is not None:
            table = self.bpe.letters
            for word in words:
                out += known(word) or self._learn(word, "".join([table[b] for b in word.encode()]))
        else:
            normal = self.library.normalizer.normalize_str(text)
            for letters, _ in self.library.pre_tokenizer.pre_tokenize_str(normal):
                out += self.bpe.word(letters)
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.special.split(text):
            if part in self.bpe.special:
                out.append(self.bpe.special[part])
            elif part:
                out += self._piece(part)
        return out

    def both(self, text: str) -> tuple[str, str]:
        """(ids joined by a space, decoded text)."""
        if tokens.only_whole(text):
            ids = self.encode(text)
            return " ".join(map(str, ids)), self.bpe.decode(ids)
        chunks = text.split()
        unknown = set(chunks).difference(self.ids)
        if len(self.ids) + len(unknown) > self.max_chunks:
            self.ids.clear()
            self.texts.clear()
            unknown = set(chunks)
        for chunk in unknown:
            ids = self._piece(chunk)
            self.ids[chunk] = " ".join(map(str, ids))
            self.texts[chunk] = self.bpe.decode(ids)
        return " ".join(map(self.ids.__getitem__, chunks)), " ".join(map(self.texts.__getitem__, chunks))


@functools.cache
def cached(name: str = tokens.WORD_BPE) -> CachedBPE:
    return CachedBPE(name)


def _round_trip(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = cached(name).both
        for batch in batches:
            for part, texts in W.pieces(batch, "text", ENCODE_BYTES):
                rows = [both(t) for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([i.count(" ") + 1 if i else 0 for i, _ in rows], pa.int64()),
                        pa.array([i for i, _ in rows], pa.string()),
                        pa.array([t for _, t in rows], pa.string()),
                    ],
                    names=["id", "n_tokens", "ids", "decoded"],
                )

    return run


def _digests(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in _round_trip(name)(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([digest(x) for x in batch.column(k).to_pylist()], pa.string()) for k in (2, 3))],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = tokens.WORD_BPE, digests: bool = False) -> DataFrame:
    """Per row of ``df``: its id, ``n_tokens``, ``ids`` (decimal, joined by one space)
    and ``decoded``; with ``digests`` the SHA-256 of both instead, made where the
    texts are, so that they don't leave the Python worker.

    Null and empty texts have no ids and decode to the empty text. Special strings
    inside texts become their own ids. Rows are independent: repeated rows give equal
    results, an empty table an empty one, and no row moves between tasks.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    run, last = (_digests, "ids_sha256 string, decoded_sha256 string") if digests else (_round_trip, "ids string, decoded string")
    return rows.mapInArrow(run(tokenizer), f"id {kind}, n_tokens long, {last}").withColumnRenamed("id", id_col)
