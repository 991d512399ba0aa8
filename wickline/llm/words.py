"""Words, lines and windows of whole Arrow batches of texts."""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

PIECE_BYTES = 2 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Tokens:
    """Items of ``n`` texts in order: ``codes`` into ``values``, ``owner`` is the text."""

    n: int
    owner: np.ndarray
    codes: np.ndarray
    values: pa.Array

    def per_text(self, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.owner, weights, minlength=self.n).astype(np.int64)


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batch in slices of at most ``limit`` bytes of text (or one row), each with
    its texts, null as empty. Bounds what the functions below hold at a time."""
    texts = batch.column(batch.schema.get_field_index(text))
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = pc.fill_null(texts, "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield batch.slice(start, i - start), texts.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(texts):
        yield batch.slice(start), texts.slice(start)
    give_back()


@functools.cache
def _trim():
    """What hands freed memory back to the system, where the C library has it."""
    name = ctypes.util.find_library("c")
    return getattr(ctypes.CDLL(name), "malloc_trim", None) if name else None


def give_back() -> None:
    """Returns freed memory: a worker that waits for its next task keeps what it doesn't
    give back, and an executor may have more workers than tasks."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def slices(batch: pa.RecordBatch, columns: list[str], limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``limit`` bytes in its binary ``columns`` (or one row)."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)
    give_back()


def _encoded(lists: pa.Array, keep: pa.Array, flat: pa.Array) -> Tokens:
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    mask = keep.to_numpy(zero_copy_only=False)
    coded = flat.filter(keep).dictionary_encode()
    return Tokens(len(lists), owner[mask], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary)


def words(texts: pa.Array) -> Tokens:
    """Runs of characters other than ASCII white space."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    return _encoded(lists, pc.greater(pc.binary_length(flat), 0), flat)


def lines(texts: pa.Array) -> Tokens:
    """Lines, parted by line feeds, that hold a word."""
    lists = pc.split_pattern(texts, "\n")
    flat = lists.flatten()
    return _encoded(lists, pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0), flat)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads close values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def content_hashes(values: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, the same in every task."""
    return np.fromiter(map(xxh3_64_intdigest, values.to_pylist()), np.uint64, len(values))


def windows(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first positions, hashes) of the windows of ``width`` items inside one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled = mix(rolled * GOLDEN + hashes[k : k + n])
    inside = owner[:n] == owner[width - 1 :]
    return np.flatnonzero(inside), rolled[inside]


def repeated(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of items whose key occurs twice or more in their text, and of those
    equal to an earlier item of it."""
    order = np.lexsort((np.arange(len(keys)), keys, owner))
    o, k = owner[order], keys[order]
    later = np.zeros(len(keys), bool)
    later[1:] = (o[1:] == o[:-1]) & (k[1:] == k[:-1])
    any_ = later.copy()
    any_[:-1] |= later[1:]
    twice, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order], again[order] = any_, later
    return twice, again


def count_bytes(texts: pa.Array, wanted: bytes) -> np.ndarray:
    """How many of the ``wanted`` ASCII bytes each text holds."""
    table = np.zeros(256, np.int64)
    table[list(wanted)] = 1
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    running = np.concatenate([[0], np.cumsum(table[data])])
    return np.diff(running[offsets - offsets[0]])
