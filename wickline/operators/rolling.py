"""Row-to-row and rolling-window measures on block windows.

All of these expect ``with_history`` to have supplied enough earlier rows, and
are evaluated before the history rows are dropped again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickline.operators.blocks import BLOCK, block_window

#: Frames of more rows are put together from chunks; shorter ones slide.
WIDE = 64


def previous(value: Column) -> Column:
    return F.lag(value, 1).over(block_window())


def difference(value: Column) -> Column:
    return value - previous(value)


def _last(length: int):
    return block_window().rowsBetween(-(length - 1), Window.currentRow)


def is_full(value: Column, length: int) -> Column:
    """Whether the last ``length`` rows are all there and non-null."""
    return F.count(value).over(_last(length)) == length


def frame_mean(value: Column, length: int) -> Column:
    return F.avg(value).over(_last(length))


def frame_std(value: Column, length: int) -> Column:
    """Population standard deviation."""
    return F.stddev_pop(value).over(_last(length))


def add_frame(framed: DataFrame, value: str, length: int, name: str) -> DataFrame:
    """``framed`` with the measures of the last ``length`` rows of a column:
    ``{name}_full``, ``{name}_mean`` and ``{name}_std`` (population)."""
    if length > WIDE:
        return _add_wide_frame(framed, value, length, name)
    x = F.col(value)
    measures = {"full": is_full(x, length), "mean": frame_mean(x, length), "std": frame_std(x, length)}
    return framed.withColumns({f"{name}_{m}": c for m, c in measures.items()})


def _add_wide_frame(framed: DataFrame, value: str, length: int, name: str) -> DataFrame:
    """The same at a cost per row that doesn't grow with the length.

    The rows of a block are cut into chunks of ``length`` rows. A frame is the end of one
    chunk and the begin of the next, and both are running measures: from the chunk's
    begin to the row, and from the frame's first row, ``length - 1`` rows back, to its
    chunk's end. Count, mean and variance of the two are merged, so nothing is ever
    subtracted from a sum. Values are taken relative to one of their chunk, which keeps
    constant series exact."""
    at, chunk, base = (f"{name}_{c}" for c in ("at", "chunk", "base"))
    in_chunk = Window.partitionBy(*BLOCK, chunk)
    whole = in_chunk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = F.col(value) - F.col(base)

    def measured(order: Column) -> Column:
        so_far = in_chunk.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        parts = {"n": F.count(x), "m": F.avg(x), "v": F.var_pop(x)}
        return F.struct(*[p.over(so_far).alias(k) for k, p in parts.items()], F.col(base).alias("b"))

    placed = (
        framed.withColumn(at, F.row_number().over(block_window()) - 1)
        .withColumn(chunk, F.expr(f"{at} div {length}"))
        .withColumn(base, F.coalesce(F.first(value, ignorenulls=True).over(whole), F.lit(0.0)))
        .withColumn(f"{name}_to", measured(F.col("ts").desc()))
        .withColumn(f"{name}_from", measured(F.col("ts").asc()))
    )
    # A frame that begins with a chunk is that chunk: nothing comes from the one before.
    behind = F.lag(f"{name}_to", length - 1).over(block_window())
    behind = F.when((F.col(at) + 1) % length != 0, behind)
    placed = placed.withColumn(f"{name}_behind", behind)
    old, new = (lambda f: F.coalesce(F.col(f"{name}_behind.{f}"), F.lit(0))), (lambda f: F.coalesce(F.col(f"{name}_from.{f}"), F.lit(0)))
    n = old("n") + new("n")
    apart = F.when((old("n") > 0) & (new("n") > 0), old("m") - new("m") + old("b") - new("b")).otherwise(0.0)
    share = old("n") / n
    mean = new("b") + new("m") + share * apart
    spread = (new("n") * new("v") + old("n") * old("v")) / n + share * (new("n") / n) * apart * apart
    full = (F.col(at) >= length - 1) & (n == length)
    measures = {"full": full, "mean": F.when(full, mean), "std": F.when(full, F.sqrt(spread))}
    helpers = [at, chunk, base, *[f"{name}_{c}" for c in ("to", "from", "behind")]]
    return placed.withColumns({f"{name}_{m}": c for m, c in measures.items()}).drop(*helpers)


def where_full(known: str, measure: str) -> Column:
    """A frame measure, null unless its frame is full."""
    return F.when(F.col(known), F.col(measure))


# SQL expressions over close, high, low and prev_close. ``greatest`` skips nulls,
# which is wanted for the first bar's true range and guarded against elsewhere.
GAIN = "if(prev_close is null, null, greatest(close - prev_close, 0D))"
LOSS = "if(prev_close is null, null, greatest(prev_close - close, 0D))"
TRUE_RANGE = "greatest(abs(high - low), abs(high - prev_close), abs(low - prev_close))"


def relative_volume(volume: Column, volume_sma: Column) -> Column:
    return volume / F.nullif(volume_sma, F.lit(0.0))


def relative_strength(avg_gain: Column, avg_loss: Column) -> Column:
    """0..100; 50 where the average loss is zero or nothing is known yet."""
    ratio = avg_gain / F.nullif(avg_loss, F.lit(0.0))
    return F.coalesce(100 - 100 / (1 + ratio), F.lit(50.0))
