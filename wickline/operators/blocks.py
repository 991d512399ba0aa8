"""Ordered work per symbol without putting a symbol into one task.

A symbol may hold a large share of all bars, so nothing here partitions the bar
table by symbol alone. The unit of work is a *block*: a fixed run of calendar
days of one symbol. Its size is bounded by days x bars per day, whatever the
length of the history. What must cross a block boundary does so through small
side tables, one or a few rows per block:

* ``with_history`` copies the last rows before a block into it, for frames that
  look back a fixed number of rows, routed by the number of rows per block;
* ``with_ordinal`` numbers rows over all blocks from per-block counts;
* ``running_total`` sums over all earlier rows from per-bucket totals.

Per-symbol windows only ever run over these side tables, whose length is bounded
by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_DAYS = 32
BLOCK = ("symbol", "block")


def with_block(df: DataFrame, days: int | None = None) -> DataFrame:
    """Add the block number of a row: whole calendar days, so a trading day
    never spans two blocks. ``wickline.blockDays`` in the session sets how many;
    32 days of five-minute bars are about 2,000 rows. Finer bars want fewer days.

    Rows that cannot be placed are dropped here, explicitly: the joins on the
    block would drop them anyway, but as an inferred filter in one branch only,
    and then two readers of the bars no longer share one shuffle.
    """
    days = days or int(df.sparkSession.conf.get("wickline.blockDays", str(BLOCK_DAYS)))
    placed = df.withColumn("block", F.floor(F.unix_date("session_date") / days).cast("int"))
    return placed.where(F.col("symbol").isNotNull() & F.col("block").isNotNull())


def block_window() -> Window:
    return Window.partitionBy(*BLOCK).orderBy("ts")


def history_routes(df: DataFrame, rows: int) -> DataFrame:
    """(symbol, block, later, take): the ``take`` newest rows of a block are among the
    ``rows`` rows before the block ``later``. From the number of rows per block: a later
    block wants what lies less than ``rows`` rows before its start."""
    counts = df.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n"))
    by_block = Window.partitionBy("symbol").orderBy("block")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    ahead = F.collect_list(F.struct(F.col("block").alias("later"), "start")).over(by_block.rowsBetween(1, rows))
    end = F.col("start") + F.col("n")
    near = F.filter(ahead, lambda b: b["start"] - end < rows)
    pairs = starts.withColumn("near", near).select("symbol", "block", end.alias("end"), F.inline("near"))
    return pairs.select("symbol", "block", "later", (F.lit(rows) - (F.col("start") - F.col("end"))).cast("int").alias("take"))


def with_history(df: DataFrame, rows: int) -> DataFrame:
    """Prepend to every block the ``rows`` rows that precede it in its symbol,
    marked ``is_history``.

    Only the newest ``rows`` rows of a block can precede a later one; the rank
    filter keeps those before the shuffle. They are joined to the blocks that want
    them (``history_routes``), so sparse blocks are bridged too, and no bar takes part
    in a window over its symbol.
    """
    own = df.withColumn("is_history", F.lit(False))
    if rows <= 0:
        return own
    newest_first = Window.partitionBy(*BLOCK).orderBy(F.desc("ts"))
    tails = df.withColumn("age", F.row_number().over(newest_first)).where(F.col("age") <= rows)
    routed = tails.join(history_routes(df, rows), list(BLOCK)).where("age <= take").withColumn("block", F.col("later"))
    return own.unionByName(routed.drop("age", "later", "take").withColumn("is_history", F.lit(True)))


def with_ordinal(
    df: DataFrame,
    name: str,
    order: list[Column | str],
    keys: tuple[str, ...] = ("symbol",),
    block: str = "block",
    total: str | None = None,
) -> DataFrame:
    """Number the rows 0, 1, ... per ``keys`` in ``order``, which must agree with
    the order of ``block``. Two passes: counts per block, then numbers inside it."""
    counts = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *keys,
        block,
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("block_start"),
        F.sum("n").over(Window.partitionBy(*keys)).alias("key_total"),
    )
    inside = F.row_number().over(Window.partitionBy(*keys, block).orderBy(*order))
    numbered = df.withColumn("in_block", inside).join(starts, [*keys, block])
    numbered = numbered.withColumn(name, F.col("block_start") + F.col("in_block") - 1)
    if total:
        numbered = numbered.withColumn(total, F.col("key_total"))
    return numbered.drop("in_block", "block_start", "key_total")


def prefix_sums(df: DataFrame, key: str, order: str, amount: str, name: str, fan: int = 1024) -> DataFrame:
    """(key, order, name): the sum of ``amount`` over all smaller numbers ``order`` of a
    key, which are unique in it. In two levels, so no task sees all rows of a key: sums
    of runs of ``fan`` numbers, then sums inside a run."""
    run = F.floor(F.col(order) / fan)
    rows = df.select(key, order, amount, run.alias("run"))
    runs = rows.groupBy(key, "run").agg(F.sum(amount).alias("run_sum"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    run_starts = runs.select(key, "run", F.coalesce(F.sum("run_sum").over(before(key).orderBy("run")), F.lit(0)).alias("run_start"))
    inside = F.coalesce(F.sum(amount).over(before(key, "run").orderBy(order)), F.lit(0))
    return rows.withColumn("inside", inside).join(run_starts, [key, "run"]).select(key, order, (F.col("run_start") + F.col("inside")).alias(name))


def running_total(
    df: DataFrame,
    name: str,
    amount: Column,
    key: str,
    ts: str,
    tie: str,
    bucket_seconds: int = 60,
) -> DataFrame:
    """Inclusive running sum of ``amount`` per ``key`` in (ts, tie) order.

    Rows are shuffled by (key, time bucket); a bucket starts from the total of
    all earlier ones. Exact for decimal amounts, whatever the bucket width.
    """
    bucket = F.floor(F.unix_seconds(ts) / bucket_seconds)
    rows = df.select("*", bucket.alias("bucket"), amount.alias("amount"))
    sums = rows.groupBy(key, "bucket").agg(F.sum("amount").alias("bucket_sum"))
    starts = prefix_sums(sums, key, "bucket", "bucket_sum", "bucket_start")
    inside = Window.partitionBy(key, "bucket").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("*", F.sum("amount").over(inside).alias("in_bucket")).join(starts, [key, "bucket"])
    return summed.select(*df.columns, (F.col("bucket_start") + F.col("in_bucket")).alias(name))
