"""Quality rules: per-document counts, and lines that too many documents of a host share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickline.llm import words as W
from wickline.llm.scratch import batches_of, free_name, written

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class QualityRules:
    """min_words, max_repeat: a document fails with fewer words, or a larger share of
    words in repeated windows. A line is above the limit when more than ``line_docs``
    distinct texts of a host hold it, whatever the size of the host: with as many, it is
    the host's and not a document's. A document is depleted when less than
    ``keep_share`` of its words is left."""

    min_words: int = 10
    max_repeat: float = 0.2
    window: int = 5
    line_docs: int = 10
    keep_share: float = 0.2


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_PROFILE = (
    "row_id long, id string, host string, digest_a long, digest_b long, "
    + ", ".join(f"{c} long" for c in _COUNTS)
    + ", lines array<struct<hash: binary, at: int, words: int>>"
)
_LINES = pa.list_(pa.struct([("hash", pa.binary()), ("at", pa.int32()), ("words", pa.int32())]))


def line_digest(line: str) -> bytes:
    """128 bits of a line with A-Z lowered and white space runs as one space."""
    return hashlib.blake2b(b" ".join(line.encode("utf-8", "surrogatepass").split()).lower(), digest_size=16).digest()


def _counts(texts: pa.Array, window: int) -> dict[str, np.ndarray]:
    words = W.words(texts)
    chars = pc.utf8_length(words.values).to_numpy(zero_copy_only=False)[words.codes] if len(words.codes) else words.codes
    lines = W.lines(texts)
    _, again = W.repeated(lines.owner, lines.codes.astype(np.uint64))
    seeds = W.mix(words.codes.astype(np.uint64) + np.uint64(1))
    first, keys = W.windows(seeds, words.owner, window)
    twice, _ = W.repeated(words.owner[first], keys)
    edge = np.zeros(len(words.codes) + window + 1, np.int64)
    np.add.at(edge, first[twice], 1)
    np.add.at(edge, first[twice] + window, -1)
    covered = (np.cumsum(edge)[: len(words.codes)] > 0).astype(np.float64)
    return {
        "n_words": words.per_text(),
        "word_chars": words.per_text(chars),
        "n_symbols": W.count_bytes(texts, SYMBOLS),
        "n_dup_lines": lines.per_text(again.astype(np.float64)),
        "n_repeat_words": words.per_text(covered),
    }


def _line_lists(texts: pa.Array) -> pa.Array:
    """Per text its lines that hold a word: digest, number in the text, words."""
    split = pc.split_pattern(texts, "\n")
    n_lines = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    flat = split.flatten()
    starts = np.concatenate([[0], np.cumsum(n_lines)])
    at = np.arange(len(flat)) - np.repeat(starts[:-1], n_lines)
    counted = W.words(flat).per_text()
    keep = counted > 0
    kept = np.concatenate([[0], np.cumsum(keep)])[starts]
    coded = flat.filter(pa.array(keep)).dictionary_encode()
    digests = pa.array([line_digest(x) for x in coded.dictionary.to_pylist()], pa.binary())
    items = pa.StructArray.from_arrays(
        [digests.take(coded.indices), pa.array(at[keep], pa.int32()), pa.array(counted[keep], pa.int32())],
        names=["hash", "at", "words"],
    )
    return pa.ListArray.from_arrays(pa.array(kept, pa.int32()), items)


def _profiler(window: int):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in W.pieces(batch, "text"):
                counts = _counts(texts, window)
                columns = [part.column(part.schema.get_field_index(c)) for c in ("row_id", "id", "host", "digest_a", "digest_b")]
                columns += [pa.array(counts[c], pa.int64()) for c in _COUNTS]
                columns.append(_line_lists(texts).cast(_LINES))
                yield pa.RecordBatch.from_arrays(columns, names=["row_id", "id", "host", "digest_a", "digest_b", *_COUNTS, "lines"])

    return profile


def _identity(id_col: str, text_col: str, host_col: str) -> dict[str, Column]:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return {
        "id": F.col(f"`{id_col}`").cast("string"),
        "host": F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")),
        "digest_a": F.xxhash64(F.lit(1), text),
        "digest_b": F.xxhash64(F.lit(2), text),
    }


def assess(df: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of ``df``: id, host, digests, counts, ``removed`` (numbers of
    the lines above the limit, null if none), ``base_failed`` and ``kept``.

    A line counts once per distinct text of a host, so exact copies of a document
    don't make its lines look common. Near copies count each: a group above the limit
    loses its shared lines, and with them all its documents if too little is left. The text is read once; all later steps read a
    table of counts and line digests. Null texts are empty and fail; a null host is
    the host ``''``; ties don't occur, as all rules are thresholds.
    """
    rows = df.select(
        F.monotonically_increasing_id().alias("row_id"),
        *[v.alias(k) for k, v in _identity(id_col, text_col, host_col).items()],
        F.col(f"`{text_col}`").alias("text"),
    )
    with batches_of(df.sparkSession):
        profiles = written(rows.mapInArrow(_profiler(rules.window), _PROFILE), "profiles")
    lines = profiles.select("row_id", "host", "digest_a", "digest_b", F.inline("lines"))
    held = lines.groupBy("host", "hash").agg(F.countDistinct("digest_a", "digest_b").alias("docs"))
    common = held.filter(F.col("docs") > rules.line_docs).select("host", "hash")
    cut = (
        lines.join(common, ["host", "hash"])
        .groupBy("row_id")
        .agg(F.sum("words").alias("cut_words"), F.sort_array(F.collect_list("at")).alias("removed"))
    )
    failed = (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") * 1000 > F.lit(round(rules.max_repeat * 1000)) * F.col("n_words")
    )
    left = F.col("n_words") - F.coalesce("cut_words", F.lit(0))
    return (
        profiles.drop("lines")
        .join(cut, "row_id", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (left * 1000 >= F.lit(round(rules.keep_share * 1000)) * F.col("n_words")))
        .drop("row_id", "cut_words")
    )


def apply_rules(df: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str | None = None) -> DataFrame:
    """The rows of ``df`` that the rules keep, their texts without the lines above the
    limit; ``chars_col`` gets the new length of a changed text. Columns as in ``df``.

    Rows of equal id, host and text have one verdict, so repeated rows stay repeated.
    """
    verdicts = assess(df, rules, id_col, text_col, host_col)
    keys = _identity(id_col, text_col, host_col)
    mine = {k: free_name(df, f"own_{k}") for k in keys}
    theirs = {k: free_name(df, f"its_{k}") for k in (*keys, "removed")}
    kept = verdicts.filter("kept").dropDuplicates(list(keys)).select(*[F.col(k).alias(v) for k, v in theirs.items()])
    on = [F.col(mine[k]).eqNullSafe(F.col(theirs[k])) for k in keys]
    joined = df.withColumns({mine[k]: v for k, v in keys.items()}).join(kept, on)
    removed = F.col(theirs["removed"])
    parts = F.filter(F.split(F.col(f"`{text_col}`"), "\n", -1), lambda _, i: ~F.array_contains(removed, i))
    out = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        text = F.when(removed.isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(parts, "\n"))
        if c == text_col:
            col = text
        elif c == chars_col:
            col = F.when(removed.isNull(), col).otherwise(F.length(text))
        out.append(col.alias(c))
    return joined.select(*out)
