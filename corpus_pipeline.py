"""A training corpus from raw documents: ``STAGES`` in order, ``run`` applies them all.

Each stage reads what the one before has written, works on all of it, and returns the
columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickline.llm.exact_dedup import exact_dedup
from wickline.llm.ngram_join import JaccardJoin, jaccard_components
from wickline.llm.packing import pack_documents
from wickline.llm.quality import apply_rules
from wickline.llm.scratch import free_name, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go; lines that more than ten texts of a host hold
    go from the texts of the others.

    Null, empty and blank texts fail. A null source is a host of its own. Rows that
    repeat have one verdict. Whole texts are judged. Any other columns pass, whatever
    their names. An empty table stays empty."""
    return apply_rules(docs, chars_col="n_chars")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays; of rows that repeat it,
    one. The join and the repeated rows are keyed by id and digest, so the copies of a
    text are spread.

    Null texts count as empty, a null id as the text '' in the key; it stays only where
    all ids of a text are null. Texts of any length are compared by digests. Any other
    columns pass, whatever their names. An empty table stays empty."""
    key, digest = free_name(docs, "id_key"), free_name(docs, "digest")
    ident = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    keyed = docs.withColumns({key: ident(F.col("doc_id")), digest: F.sha2(F.coalesce("text", F.lit("")), 256)})
    kept = exact_dedup(docs.select("doc_id", "text"), keep="smallest").filter("kept")
    kept = kept.select(ident(F.col("doc_id")).alias(key), F.col("text_sha256").alias(digest))
    stay = keyed.join(kept, [key, digest], "left_semi").dropDuplicates([key, digest])
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the row with the smallest doc_id stays.

    Null, empty and blank texts have no words and link with nothing, so they stay. Null
    ids come last in their component. Rows that repeat the one that stays stay with it
    (the stage before leaves none). Whole texts are compared. Any other columns pass,
    whatever their names. An empty table stays empty."""
    found = jaccard_components(docs.select("doc_id", "text"), JaccardJoin())
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash"))
    kept = found.groupBy("component").agg(first.alias("first"))
    theirs, their_hash = free_name(docs, "kept_id"), free_name(docs, "kept_hash")
    kept = kept.select(F.col("first.id").alias(theirs), F.col("first.text_hash").alias(their_hash))
    mine = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(theirs)) & (mine == F.col(their_hash)), "left_semi")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens, one row per piece.

    Null and empty texts are an end token alone; longer documents are cut into pieces.
    Rows that repeat are documents of their own. Columns other than doc_id and text
    aren't looked at. An empty table gives an empty result."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]

#: SQL doesn't express the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
