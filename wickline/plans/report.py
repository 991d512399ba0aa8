"""Summaries, trade log, example trades and their surroundings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickline.functions.pricing import fallback_contract
from wickline.functions.text import minute, or_dash, percent, thousands, two_decimals
from wickline.operators.blocks import with_block, with_ordinal

TRENDS = ("Uptrend", "Downtrend")
CONTEXT_BARS = 20
MARKS = ("side", "exit_reason", "option_return_pct", "entry_price", "exit_price")


def _totals() -> list[Column]:
    total, wins = F.count("side"), F.count_if(F.col("hit_target"))
    net, total_r = F.coalesce(F.sum("pnl_usd"), F.lit(0.0)), F.coalesce(F.sum("r_multiple"), F.lit(0.0))
    share = F.nullif(total, F.lit(0).cast("bigint"))
    return [
        total.alias("total"),
        wins.alias("wins"),
        (total - wins).alias("losses"),
        net.alias("net_pnl"),
        total_r.alias("total_r"),
        F.coalesce(total_r / share, F.lit(0.0)).alias("avg_r"),
        F.coalesce(wins / share, F.lit(0.0)).alias("win_rate"),
    ]


def summary(trades: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts, P&L, R and win rate, overall or by given columns. Every setup is a
    completed trade, none stays open."""
    out = trades.groupBy(*by).agg(*_totals())
    return out.withColumns({"setups": F.col("total"), "incomplete": F.lit(0).cast("bigint")})


def summary_by_trend(trades: DataFrame) -> DataFrame:
    """One row per trend, up before down, zeros where there are no trades."""
    spark = trades.sparkSession
    both = spark.range(len(TRENDS)).selectExpr(
        "cast(id as int) as trend_order", f"array{TRENDS}[cast(id as int)] as trend"
    )
    found = trades.groupBy("trend").agg(*_totals())
    joined = both.join(found, "trend", "left")
    zeros = {c: 0 for c in found.columns if c != "trend"}
    return joined.fillna(zeros)


def _numbered(trades: DataFrame, overall: bool) -> DataFrame:
    """Add ``n``, the place of a trade in entry order: of its symbol, or of all."""
    ties = ["side", "reason", "exit_time", "entry_price"]  # trades of several strategies at one bar
    if overall:
        return with_ordinal(with_block(trades, days=1), "n", ["entry_time", "symbol", *ties], keys=())
    return with_ordinal(with_block(trades), "n", ["entry_time", *ties])


def _zoned(local: str, instant: str) -> Column:
    """Wall clock with its offset from UTC, as ISO text."""
    minutes = F.expr(f"cast((unix_seconds(cast({local} as timestamp)) - unix_seconds({instant})) / 60 as int)")
    size = F.abs(minutes)
    offset = F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(size / 60), size % 60)
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), offset)


def trade_log(trades: DataFrame, overall: bool = False) -> DataFrame:
    """The 19 columns of the trade log. ``trade_id`` counts from 1 in entry order
    per symbol, or over all symbols with ``overall``; numbers come from counts per
    block of days, so neither pulls the trades into one task."""
    return _log(trades, overall, F.col("entry_local"), F.col("exit_local"))


def _log(trades: DataFrame, overall: bool, entry: Column, exit_: Column) -> DataFrame:
    # The names and the order of the log's columns.
    return _numbered(trades, overall).select(
        "symbol",
        (F.col("n") + 1).alias("trade_id"),
        entry.alias("entry_time"),
        exit_.alias("exit_time"),
        "side",
        F.coalesce(
            F.nullif(F.col("option_contract"), F.lit("")), fallback_contract(F.col("symbol"), F.col("side"))
        ).alias("option_contract"),
        "option_entry_price",
        "option_exit_price",
        F.col("entry_price").alias("underlying_entry_price"),
        F.col("exit_price").alias("underlying_exit_price"),
        "bars_held",
        F.col("reason").alias("signal_reason"),
        "exit_reason",
        "hit_target",
        "option_return_pct",
        "pnl_usd",
        "r_multiple",
        "trend",
        "pricing_mode",
        "option_lookup_status",
    )


def write_trade_log(trades: DataFrame, path: str, overall: bool = False, mode: str = "errorifexists") -> None:
    """CSV with a header, times with their offset from UTC. Per symbol by default, in one directory per symbol;
    ``overall`` writes one log with the plain 19 columns. Both are range-sorted, so
    file order is trade order and a long log is split over tasks."""
    log = _log(trades, overall, _zoned("entry_local", "entry_time"), _zoned("exit_local", "exit_time"))
    if overall:
        log.orderBy("trade_id").drop("symbol").write.mode(mode).option("header", True).csv(path)
    else:
        log.orderBy("symbol", "trade_id").write.mode(mode).partitionBy("symbol").option("header", True).csv(path)


def display_summary(trades: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The summary as text: amounts with thousands, shares in percent."""
    found = summary(trades, by)
    return found.select(
        *by,
        *[F.col(c).cast("string").alias(c) for c in ("setups", "total", "wins", "losses", "incomplete")],
        F.concat(F.lit("$"), thousands(F.col("net_pnl"))).alias("net_pnl"),
        thousands(F.col("total_r")).alias("total_r"),
        two_decimals(F.col("avg_r")).alias("avg_r"),
        percent(F.col("win_rate")).alias("win_rate"),
    )


def display_log(trades: DataFrame, overall: bool = False) -> DataFrame:
    """The log as text: minutes, two decimals, ``-`` for what is missing."""

    contract = or_dash(F.nullif(F.col("option_contract"), F.lit("")))
    opt_in, opt_out = F.col("option_entry_price"), F.col("option_exit_price")
    return _numbered(trades, overall).select(
        "symbol",
        (F.col("n") + 1).alias("number"),
        minute(F.col("entry_local")).alias("entry_time"),
        minute(F.col("exit_local")).alias("exit_time"),
        "side",
        two_decimals(F.col("entry_price")).alias("spot_in"),
        two_decimals(F.col("exit_price")).alias("spot_out"),
        contract.alias("option"),
        or_dash(two_decimals(opt_in)).alias("option_in"),
        or_dash(two_decimals(opt_out)).alias("option_out"),
        F.col("pricing_mode").alias("mode"),
        F.col("option_lookup_status").alias("lookup_status"),
        "exit_reason",
        percent(F.col("option_return_pct")).alias("option_return"),
        two_decimals(F.col("pnl_usd")).alias("pnl"),
        two_decimals(F.col("r_multiple")).alias("r"),
    )


def example_trades(trades: DataFrame, count: int = 2) -> DataFrame:
    """Per symbol: the earliest winner, the earliest loser, then the earliest
    others, up to ``count``, in that order as ``example``.

    Only the first ``count`` winners and losers can be among them; the rank filter
    keeps no more before the shuffle.
    """
    if count <= 0:
        return trades.withColumn("example", F.lit(0)).limit(0)
    ties = ["side", "reason", "exit_time", "entry_price"]
    same = Window.partitionBy("symbol", "hit_target").orderBy("entry_time", *ties)
    early = trades.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= count)
    priority = F.when(F.col("nth") > 1, 2).when(F.col("hit_target"), 0).otherwise(1)
    picked = early.withColumn("priority", priority)
    order = Window.partitionBy("symbol").orderBy("priority", "entry_time", *ties)
    ranked = picked.withColumn("example", F.row_number().over(order)).where(F.col("example") <= count)
    return ranked.drop("nth", "priority")


def trade_context(examples: DataFrame, indexed: DataFrame, around: int = CONTEXT_BARS, marks: bool = False) -> DataFrame:
    """Prepared bars from ``around`` bars before the entry to as many after the
    exit, with their position, and marks at entry and exit. With ``marks`` each row
    also has what labels the trade: side, exit reason, return and its own entry and
    exit price, which for a stop or a target isn't the close of the bar.

    The wanted ordinals are spelled out, which makes it an equi-join on
    (symbol, bar_idx); rows beyond either end of the series do not exist.
    """
    first = F.greatest(F.col("entry_idx") - around, F.lit(0))
    wanted = examples.select(
        "symbol",
        "entry_idx",
        "exit_idx",
        "example",
        *[F.col(c) for c in MARKS if marks],
        first.alias("first_idx"),
        F.explode(F.sequence(first, F.col("exit_idx") + around)).alias("bar_idx"),
    )
    bars = indexed.select(
        "symbol", "bar_idx", "local_ts", "close", "bb_upper", "bb_basis", "bb_lower", "rsi"
    )
    return wanted.join(bars, ["symbol", "bar_idx"]).select(
        "symbol",
        "example",
        (F.col("bar_idx") - F.col("first_idx")).alias("position"),
        "local_ts",
        "close",
        "bb_upper",
        "bb_basis",
        "bb_lower",
        "rsi",
        (F.col("bar_idx") == F.col("entry_idx")).alias("is_entry"),
        (F.col("bar_idx") == F.col("exit_idx")).alias("is_exit"),
        *[F.col(c) for c in MARKS if marks],
    )
