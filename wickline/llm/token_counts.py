"""Token counts through a cache keyed by content and tokenizer digests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wickline.llm import tokens
from wickline.llm import words as W
from wickline.llm.scratch import free_name

CACHE_SCHEMA = "content_digest string, tokenizer_digest string, n_tokens long"
ENCODE_BYTES = 2 << 20


def tokenizer_digest(name: str) -> str:
    return hashlib.sha256(Path(public_tokenizers.path(name)).read_bytes()).hexdigest()


def _counter(name: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(name).encode
        for batch in batches:
            for part, texts in W.pieces(batch, "text", ENCODE_BYTES):
                counts = pa.array([len(ids) // 4 for ids in encode(texts.to_pylist())], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), counts], names=["content_digest", "n_tokens"])

    return count


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(content_digest, n_tokens) that the cache holds for a tokenizer version; of
    entries that two writers added for the same content one is taken. Grouped by both
    digests, so that a join on content has an exchange of its own below it, which lets
    Spark split the rows of a content with many copies."""
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (p.split() for p in CACHE_SCHEMA.split(", "))]
    spark.range(0).select(*nothing).write.mode("append").parquet(cache)  # makes the table
    held = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer_digest") == version)
    return held.groupBy("tokenizer_digest", "content_digest").agg(F.max("n_tokens").alias("n_tokens")).drop("tokenizer_digest")


def count_tokens(
    df: DataFrame,
    cache: str,
    tokenizer: str = tokens.WORD_BPE,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = lambda text: text,
) -> DataFrame:
    """``df`` with ``content_digest`` and ``n_tokens``.

    ``cache`` is the path of a Parquet table in a store that all executors share; it
    is made if it is missing. Distinct contents without an entry for this tokenizer
    version are encoded once and appended, then all rows are joined to the cache.
    ``normalise`` may only undo differences that the tokenizer ignores.

    Null texts count as empty and have 0 tokens. The text of a content comes from the
    row with its smallest id, found by a join on digest and id, which spreads the
    copies of a text. Rows repeated with their id are encoded more than once and
    counted alike. An empty table adds nothing to the cache. Columns named
    ``content_digest`` or ``n_tokens`` are replaced.
    """
    spark, version = df.sparkSession, tokenizer_digest(tokenizer)
    content = normalise(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    keyed = df.select(F.sha2(content, 256).alias("content_digest"), F.col(f"`{id_col}`").cast("string").alias("id"), content.alias("text"))
    firsts = keyed.groupBy("content_digest").agg(F.min("id").alias("first_id"))
    misses = firsts.join(stored_counts(spark, cache, version), "content_digest", "left_anti")
    wanted = keyed.join(
        misses.withColumnRenamed("content_digest", "missed"),
        (F.col("content_digest") == F.col("missed")) & F.col("id").eqNullSafe(F.col("first_id")),
        "left_semi",
    ).select("content_digest", "text")
    fresh = wanted.mapInArrow(_counter(tokenizer), "content_digest string, n_tokens long")
    fresh.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache)
    mine, theirs, n = (free_name(df, c) for c in ("own_digest", "cached_digest", "cached_tokens"))
    passed = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("content_digest", "n_tokens")]
    return (
        df.withColumn(mine, F.sha2(content, 256))
        .join(stored_counts(spark, cache, version).toDF(theirs, n), F.col(mine) == F.col(theirs), "left")
        .select(*passed, F.col(mine).alias("content_digest"), F.col(n).alias("n_tokens"))
    )
