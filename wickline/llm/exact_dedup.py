"""Exact dedup by a tree merge of sorted digest runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickline.llm.scratch import free_name

FAN_IN = 8

RUN_SCHEMA = "run int, digest string, n_bytes long, check_hash long, best {kind}, n long"
_KEY = ("digest", "n_bytes", "check_hash")


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by run and key, best id first, to one row per run and key. A group
    that goes on in the next batch is carried over, so memory holds one batch."""
    carry = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table.cast(pa.schema([(f.name, f.type) for f in table.schema]))
        if carry is not None:
            table = pa.concat_tables([carry, table])
        table = table.combine_chunks()
        n = table.num_rows
        if n == 0:
            continue
        new = np.ones(n, dtype=bool)
        if n > 1:
            same = np.ones(n - 1, dtype=bool)
            for name in ("run", *_KEY):
                col = table.column(name).combine_chunks()
                same &= pc.equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[1:] = ~same
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(table.column("n").to_numpy(), starts)
        heads = table.take(pa.array(starts)).set_column(5, "n", pa.array(sums, pa.int64()))
        carry = heads.slice(heads.num_rows - 1)
        if heads.num_rows > 1:
            yield from heads.slice(0, heads.num_rows - 1).to_batches()
    if carry is not None:
        yield from carry.to_batches()


def merge_runs(runs: DataFrame, cells: int, keep: str = "largest", fan_in: int = FAN_IN) -> DataFrame:
    """Digest runs (``RUN_SCHEMA``) to one row per digest, by rounds of exchanges.

    Spark's sort does the merging of the pieces that a partition gets, and ``_collapse``
    passes over them once. In round r the ``fan_in`` runs of a group each hand out their digests by the next
    digit of the digest, so that partition (group, digits) merges ``fan_in`` sorted
    pieces: ``fan_in`` times fewer groups, ``fan_in`` times more slices, the same
    number of partitions. Every level drops what it has seen. After the last round one
    group is left and its slices partition the digests. A digest comes from a group
    at most once per run, however many copies it has.
    """
    order = F.col("best").desc_nulls_last() if keep == "largest" else F.col("best").asc_nulls_last()
    hashed = F.abs(F.xxhash64("digest") % F.lit(cells)).cast("int")
    schema = RUN_SCHEMA.format(kind=runs.schema["best"].dataType.simpleString())
    groups, width = cells, 1
    while groups > 1:
        groups, width = groups // fan_in, width * fan_in
        placed = runs.withColumns({"run": F.expr(f"run div {fan_in}").cast("int"), "slice": hashed % width})
        runs = (
            placed.repartition(cells, "run", "slice")
            .drop("slice")
            .sortWithinPartitions("run", *_KEY, order)
            .mapInArrow(_collapse, schema)
        )
    return runs


def digest_runs(df: DataFrame, digest: Column, n_bytes: Column, check: Column, id_col: str, cells: int, keep: str) -> DataFrame:
    """One locally sorted and collapsed run of digests per input partition."""
    order = F.col("best").desc_nulls_last() if keep == "largest" else F.col("best").asc_nulls_last()
    rows = df.select(
        F.pmod(F.spark_partition_id(), F.lit(cells)).cast("int").alias("run"),
        digest.alias("digest"),
        n_bytes.alias("n_bytes"),
        check.alias("check_hash"),
        F.col(f"`{id_col}`").alias("best"),
        F.lit(1).cast("long").alias("n"),
    )
    schema = RUN_SCHEMA.format(kind=rows.schema["best"].dataType.simpleString())
    return rows.sortWithinPartitions("run", *_KEY, order).mapInArrow(_collapse, schema)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = FAN_IN) -> DataFrame:
    """``df`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Rows are equal when their texts are identical; null counts as the empty text.
    ``keep`` names the identifier that stays, ``smallest`` or ``largest`` by the order of
    its type (strings by their bytes); a null identifier loses against any other. The identity of a text is its SHA-256,
    verified at every level by its length in bytes and a second, independent 64-bit
    hash: rows that differ in either aren't merged. Rows that repeat an identifier
    and its text all count in ``group_size`` and are all kept or dropped together.
    An empty table gives an empty result; other columns pass through.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = fan_in
    while cells < partitions:
        cells *= fan_in
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keys = {"digest": F.sha2(text, 256), "n_bytes": F.octet_length(text).cast("long"), "check_hash": F.xxhash64(text)}
    runs = digest_runs(df, *keys.values(), id_col, cells, keep)
    merged = merge_runs(runs, cells, keep, fan_in)
    mine = {k: free_name(df, f"own_{k}") for k in keys}
    theirs = {k: free_name(df, f"run_{k}") for k in (*keys, "best", "n")}
    right = merged.select(*[F.col(k).alias(v) for k, v in theirs.items()])
    joined = df.withColumns({mine[k]: v for k, v in keys.items()}).join(
        right, [F.col(mine[k]) == F.col(theirs[k]) for k in keys], "left"
    )
    added = {
        "keep_id": F.col(theirs["best"]),
        "group_size": F.col(theirs["n"]),
        "kept": F.col(f"`{id_col}`").eqNullSafe(F.col(theirs["best"])),
        "text_sha256": F.col(mine["digest"]),
    }
    passed = [F.col(f"`{c}`") for c in df.columns if c.lower() not in added]
    return joined.select(*passed, *[v.alias(k) for k, v in added.items()])
