"""Importance resampling towards a target distribution by hashed n-gram features."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickline.llm import words as W
from wickline.llm.scratch import written

SCAN_BYTES = 2 << 20
SHORT = 64

# A-Z lowered, every ASCII character that is no letter or digit a space. All of them are
# single bytes, so UTF-8 can be mapped byte by byte.
_WORD_BYTES = bytes(b for b in range(256) if chr(b).isalnum() and b < 128 or b >= 128)
NORMAL = bytes(ord(chr(b).lower()) if b < 128 and b in _WORD_BYTES else b if b >= 128 else 32 for b in range(256))
#: Ends a text in a scanned block. NORMAL maps NUL away, so no text holds it.
END = b" \0 "


@dataclass(frozen=True)
class Resampling:
    """``longest``: words of the longest feature. ``buckets``: feature buckets.
    Of the documents with at least ``min_words`` words, ``percent`` of a hundred are
    drawn. ``seed`` makes the noise of the draw."""

    longest: int = 3
    buckets: int = 10_000
    min_words: int = 20
    percent: int = 5
    seed: int = 42


# ------------------------------------------------------------------ CRC composition


@functools.cache
def _one_byte() -> np.ndarray:
    """Per byte of a register the register after one zero byte: shape (4, 256)."""
    step = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)
    register = np.arange(256, dtype=np.uint32)
    return np.stack([step] + [register << np.uint32(8 * k - 8) for k in (1, 2, 3)])


def _applied(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = table[0][crc & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ table[k][(crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


@functools.cache
def _short_tables() -> np.ndarray:
    """The same for 0 to ``SHORT - 1`` zero bytes: shape (4, SHORT, 256)."""
    byte = np.arange(256, dtype=np.uint32)
    tables = [np.stack([byte << np.uint32(8 * k) for k in range(4)])]
    for _ in range(SHORT - 1):
        tables.append(np.stack([_applied(_one_byte(), row) for row in tables[-1]]))
    return np.ascontiguousarray(np.stack(tables, axis=1))


def crc_joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of concatenations, from those of both parts and the second's length."""
    tables = _short_tables()
    crc, left = first.astype(np.uint32), length.astype(np.int64)
    while True:
        now = np.minimum(left, SHORT - 1)
        moved = tables[0, now, crc & np.uint32(255)]
        for k in (1, 2, 3):
            moved = moved ^ tables[k, now, (crc >> np.uint32(8 * k)) & np.uint32(255)]
        crc, left = moved, left - now
        if not left.any():
            return crc ^ second.astype(np.uint32)


# ----------------------------------------------------------------- dictionary scans


def _dictionary(normal: bytes) -> tuple[ahocorasick.Automaton, np.ndarray, np.ndarray]:
    """An automaton of the distinct words of a block, each between its delimiters, and
    their payloads: CRC and length. (The automaton stores 32-bit numbers, so it holds a
    word's place in the payloads.)"""
    words = [w for w in set(normal.split(b" ")) if w]
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, word in enumerate(words):
        found.add_word(f" {word.decode('utf-8', 'surrogateescape')} ", k)
    found.add_word(END.decode(), -1)
    found.make_automaton()
    return found, np.array([*map(zlib.crc32, words)], np.uint32), np.array([*map(len, words)], np.int64)


def scan_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, crc, length) of every word of the texts, in order. Words that follow each
    other share their delimiter; the automaton emits both, as it reports overlaps."""
    normal = [t.translate(NORMAL) for t in texts]
    automaton, crc, length = _dictionary(b" ".join(normal))
    block = (b" " + END.join(normal) + END).decode("utf-8", "surrogateescape")
    emitted = np.fromiter((payload for _, payload in automaton.iter(block)), np.int64)
    owner = np.cumsum(emitted < 0)
    word = emitted >= 0
    payload = emitted[word]
    return owner[word], crc[payload], length[payload]


def feature_buckets(texts: list[bytes], rule: Resampling) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Words per text, and per feature width the (owner, bucket) of its features. A
    feature's CRC is put together from the payloads of its words."""
    owner, crc, length = scan_words(texts)
    counts = np.bincount(owner, minlength=len(texts))

    def widths() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        spaced = crc_joined(np.full(len(crc), zlib.crc32(b" "), np.uint32), crc, length) if len(crc) else crc
        whole, own = crc, owner
        for width in range(rule.longest):
            if width:
                whole = crc_joined(whole[:-1], spaced[width:], length[width:] + 1) if len(whole) > 1 else whole[:0]
                own = owner[: len(whole)]
            inside = own == owner[width : width + len(own)]
            yield own[inside], (whole[inside] % np.uint32(rule.buckets)).astype(np.int64)

    return counts, widths()


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for part, texts in W.pieces(batch, "text", SCAN_BYTES):
        yield part, texts.cast(pa.large_binary()).to_pylist()


# --------------------------------------------------------------- counting and scoring


def _bucket_counter(rule: Resampling):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(rule.buckets, np.int64)
        for batch in batches:
            for _, texts in _blocks(batch):
                for _, buckets in feature_buckets(texts, rule)[1]:
                    total += np.bincount(buckets, minlength=rule.buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, rule: Resampling) -> DataFrame:
    """(bucket, n): features of all ``text`` per bucket, added up in the tasks first."""
    return texts.select("text").mapInArrow(_bucket_counter(rule), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, rule: Resampling) -> np.ndarray:
    """Per bucket floor(1000 * ln(ratio of the smoothed shares of target and corpus)).
    The driver gets one row a bucket."""
    counts = []
    for texts in (corpus, target):
        held = np.zeros(rule.buckets, np.int64)
        for row in bucket_counts(texts, rule).collect():
            held[row.bucket] = row.n
        counts.append(held)
    (s, big_s), (t, big_t) = ((c.astype(np.float64), float(c.sum())) for c in counts)
    ratio = ((t + 1) * (big_s + rule.buckets)) / ((s + 1) * (big_t + rule.buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _scorer(rule: Resampling, shared_gains):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = shared_gains.value
        for batch in batches:
            for part, texts in _blocks(batch):
                n_words, widths = feature_buckets(texts, rule)
                n_features, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                for owner, buckets in widths:
                    n_features += np.bincount(owner, minlength=len(texts))
                    # sums of whole numbers far below 2 ** 53
                    weight += np.bincount(owner, gains[buckets], len(texts)).astype(np.int64)
                columns = [part.column(part.schema.get_field_index("id")), *map(pa.array, (n_words, n_features, weight))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_features", "weight"])

    return run


def _ranked(eligible: DataFrame, percent: int) -> DataFrame:
    """``eligible`` with ``rank``: 1, 2, ... by score downwards, then id, for the first
    ``percent`` of a hundred rows, else null. Rows are dealt by ranges and sorted there;
    a range starts behind the rows of those before it, so no task sees all rows."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    placed = eligible.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("at", F.monotonically_increasing_id()), "order")
    sizes = placed.groupBy(F.shiftright("at", 33).alias("part")).count().orderBy("part").collect()
    starts, total = [], 0
    for row in sizes:
        starts.append((row["part"], total))
        total += row["count"]
    drawn = percent * total // 100
    offsets = placed.sparkSession.createDataFrame(starts, "part long, start long")
    rank = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    numbered = placed.withColumn("part", F.shiftright("at", 33)).join(offsets, "part")
    return numbered.withColumn("rank", F.when(rank <= drawn, rank)).select(*eligible.columns, "rank")


def resample(
    df: DataFrame,
    target: DataFrame,
    rule: Resampling = Resampling(),
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """One row per row of ``df``: its id, ``n_words``, ``n_features``, ``weight``,
    ``score``, and ``rank`` if it is drawn.

    Features are runs of one to ``longest`` words, words being runs of letters, digits
    and non-ASCII characters with A-Z lowered. A block of texts is scanned by an
    automaton of its distinct words, whose payloads (CRC and length) are composed to
    the CRC of each feature, hence its bucket. Counts of the corpus and the target give
    a gain per bucket; a document's weight is the sum over its features, its score adds
    Gumbel noise drawn from its id, and the highest scores are drawn: a sample without
    replacement, in proportion to the importance weights.

    Null, empty and wordless texts have no feature, weight 0, and are never drawn. A
    null id takes the noise of an empty id and comes last in a tie. Repeated rows count
    each and have the same score; which of them has the smaller rank is open. Empty
    tables: no rows, or gains against an empty target. Other columns aren't looked at.
    A block holds at most 2 MB of texts, or one longer text whole.
    """
    ident = F.col(f"`{id_col}`")
    rows = df.select(ident.alias("id"), F.col(f"`{text_col}`").alias("text"))
    gains = bucket_gains(rows, target.select(F.col(f"`{target_text_col}`").alias("text")), rule)
    kind = rows.schema["id"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(gains)
    scored = rows.mapInArrow(_scorer(rule, shared), f"id {kind}, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{rule.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = written(scored.withColumn("score", F.col("weight") + noise), "scores")
    enough = F.col("n_words") >= rule.min_words
    rest = scored.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    return _ranked(scored.filter(enough), rule.percent).unionByName(rest).withColumnRenamed("id", id_col)
