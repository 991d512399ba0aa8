"""Token ids of whole texts, as a tokenizers file gives them, with a cache of chunks."""

from __future__ import annotations

import functools
import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from wickline.llm import words as W

WORD_BPE = "word_bpe_49k.json"

# Fixed values of word_bpe_49k.json: its pattern of words and the mark of a word's last token.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WORD_END = "</w>"

# Controls that some splits at white space part at, the tokenizer doesn't; "<|" may begin a special string.
WHOLE = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
# Characters that normalisation leaves alone but for lowering, one by one.
PLAIN = re.compile("[\x21-\x7e\xa1-įı-ſ]+")

# Letters among them: a run of these is one word.
LETTERS = "^[A-Za-zÀ-ÖØ-öø-įı-ſ]+$"

# Bounds of the caches of a Python worker; an executor may keep more workers than tasks.
WORD_ENTRIES = 50_000
CHUNK_ENTRIES = 25_000
JOINED = 100


def only_whole(text: str) -> bool:
    """Whether a text can't be cut at white space."""
    return any(mark in text for mark in WHOLE)


def plain_words(chunk: str) -> list[str] | None:
    """The words of a chunk of plain characters, else None."""
    if chunk.isascii():
        if chunk.isalpha():
            return [chunk.lower()]
        if chunk[:-1].isalpha() and chunk[-1] in ".,":
            return [chunk[:-1].lower(), chunk[-1]]
    return WORD.findall(chunk.lower()) if PLAIN.fullmatch(chunk) else None


@functools.cache
def load(name: str) -> Tokenizer:
    """The tokenizer of a file, from the public package's folder on this executor."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _joined(ids: np.ndarray, size: np.ndarray, items: np.ndarray) -> np.ndarray:
    """The ids of ``items`` one after the other; ``ids`` holds those of all, by their sizes."""
    repeats, starts = size[items], np.cumsum(size) - size
    behind = np.cumsum(repeats)
    at = np.repeat(starts[items] - behind + repeats, repeats)
    return ids[at + np.arange(len(at))]


class Recent:
    """A bounded dictionary of two generations: when the young one is full it becomes
    the old one, and what is asked for again moves to the young one. So what comes often
    stays, whatever passes through."""

    def __init__(self, entries: int):
        self.entries = entries
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __len__(self) -> int:
        return len(self.young) + len(self.old)

    def found(self, keys: list[str]) -> list[bytes | None]:
        out = list(map(self.young.get, keys))
        if self.old:
            get, young = self.old.get, self.young
            for i, value in enumerate(out):
                if value is None:
                    out[i] = value = get(keys[i])
                    if value is not None:
                        young[keys[i]] = value
        return out

    def add(self, keys: list[str], values: list[bytes]) -> None:
        if len(self.young) + len(keys) > self.entries:
            self.old, self.young = self.young, {}
        self.young.update(zip(keys, values))


class ChunkEncoder:
    """Encodes texts chunk by chunk (runs without ASCII white space): no token of a
    word tokenizer crosses white space, so the ids of a text are those of its chunks.
    The distinct chunks of a batch are cut into words, those that aren't letters and a
    mark are looked up first; unknown words are encoded by the library; texts with special strings or odd controls go to
    the library whole. What is remembered of chunks and words is bounded."""

    def __init__(self, name: str = WORD_BPE, words: int = WORD_ENTRIES, chunks: int = CHUNK_ENTRIES):
        self.tokenizer = load(name)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith(WORD_END)
        self.chunks, self.words = Recent(chunks), Recent(words)

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """ASCII words are their own byte letters and go to the library's model, without
        the offsets that its whole pipeline keeps; others are encoded many at a time."""
        tokenize = self.tokenizer.model.tokenize
        out = [array("I", [t.id for t in tokenize(w)]).tobytes() if w.isascii() else None for w in words]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i in range(0, len(rest), JOINED):
            group = [words[k] for k in rest[i : i + JOINED]]
            ids = self._library(" ".join(group))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(group) and cuts[-1] == len(ids):
                raw, at = ids.tobytes(), (4 * cuts).tolist()
                parts = [raw[a:b] for a, b in zip([0, *at], at)]
            else:
                parts = [self._library(w).tobytes() for w in group]
            for k, part in zip(rest[i : i + JOINED], parts):
                out[k] = part
        return out

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        out = self.words.found(words)
        missing = [i for i, known in enumerate(out) if known is None]
        unknown = [words[i] for i in missing]
        encoded = self._encode_words(unknown)
        self.words.add(unknown, encoded)
        for i, ids in zip(missing, encoded):
            out[i] = ids
        return out

    def _learn(self, chunks: list[str]) -> list[bytes]:
        parted = [plain_words(c) for c in chunks]
        words = list({w for ws in parted if ws for w in ws})
        ids = dict(zip(words, self._ids_of(words)))
        out = [
            self._library(c).tobytes() if ws is None else ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])
            for c, ws in zip(chunks, parted)
        ]
        self.chunks.add(chunks, out)
        return out

    def _other_ids(self, chunks: list[str]) -> list[bytes]:
        parts = self.chunks.found(chunks)
        unknown = [i for i, part in enumerate(parts) if part is None]
        for i, part in zip(unknown, self._learn([chunks[i] for i in unknown])):
            parts[i] = part
        return parts

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of distinct chunks. Letters, with a full stop or comma at their end
        or without, are parted for all at once, and those that differ by case or mark
        only are one word."""
        bare = pc.ascii_rtrim(chunks, characters=".,")
        cut = pc.subtract(pc.binary_length(chunks), pc.binary_length(bare)).to_numpy(zero_copy_only=False)
        letters = pc.match_substring_regex(bare, LETTERS).to_numpy(zero_copy_only=False) & (cut <= 1)
        words = pc.utf8_lower(bare.filter(pa.array(letters))).dictionary_encode()
        marks = np.where(cut == 1, np.where(pc.ends_with(chunks, "."), 1, 2), 0)
        known = [b"", *self._ids_of([".", ","]), *self._ids_of(words.dictionary.to_pylist())]
        others = self._other_ids(chunks.filter(pa.array(~letters)).to_pylist())
        items = np.zeros((len(chunks), 2), np.int64)
        items[letters, 0] = words.indices.to_numpy(zero_copy_only=False) + 3
        items[letters, 1] = marks[letters]
        items[~letters, 0] = len(known) + np.arange(len(others))
        parts = known + others
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        ids = _joined(np.frombuffer(b"".join(parts), "<u4"), size, items.ravel())
        return ids, size[items].sum(axis=1)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        whole = [only_whole(t) for t in texts]
        found = W.words(pa.array(["" if w else t for t, w in zip(texts, whole)], pa.large_string()))
        ids, size = self._chunk_ids(found.values)
        raw = _joined(ids, size, found.codes).tobytes()
        ends = (4 * np.cumsum(found.per_text(size[found.codes].astype(float)))).tolist()
        return [self._library(t).tobytes() if w else raw[a:b] for t, w, a, b in zip(texts, whole, [0, *ends], ends)]


@functools.cache
def encoder(name: str = WORD_BPE) -> ChunkEncoder:
    """One encoder per Python worker; its cache outlives a task."""
    return ChunkEncoder(name)
