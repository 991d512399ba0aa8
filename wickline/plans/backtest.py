"""Bars and a strategy in, trades out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickline.functions import pricing as P
from wickline.operators.blocks import with_block, with_ordinal
from wickline.operators.outcomes import candidate_outcomes, non_overlapping
from wickline.params import Risk
from wickline.plans.strategy import Strategy
from wickline.sources.bars import nan_to_null

TRADE_COLUMNS = (
    "symbol",
    "session_date",
    "entry_idx",
    "exit_idx",
    "entry_time",
    "exit_time",
    "entry_local",
    "exit_local",
    "side",
    "entry_price",
    "exit_price",
    "bars_held",
    "hit_target",
    "option_return_pct",
    "pnl_usd",
    "r_multiple",
    "trend",
    "reason",
    "exit_reason",
    "option_contract",
    "option_entry_price",
    "option_exit_price",
    "pricing_mode",
    "option_lookup_status",
)


def indexed_bars(bars: DataFrame, strategy: Strategy) -> DataFrame:
    """Prepared bars without incomplete rows, numbered per symbol. NaN is missing, in
    the numbering as in the rows kept."""
    complete = strategy.prepare(nan_to_null(bars)).dropna()
    if "block" not in complete.columns:
        complete = with_block(complete)
    if "bar_idx" in complete.columns:
        return complete
    return with_ordinal(complete, "bar_idx", ["ts"], total="bar_idx_total")


def signals(bars: DataFrame, strategy: Strategy) -> DataFrame:
    """Prepared rows that carry a signal."""
    judged = indexed_bars(bars, strategy).withColumn("signal", strategy.signal())
    return judged.where(F.col("signal").isNotNull()).select("*", "signal.side", "signal.reason").drop("signal")


def price_trades(chosen: DataFrame, risk: Risk) -> DataFrame:
    """Estimated option return, P&L and R of each trade, in trade layout."""
    ret = P.estimated_return(F.col("side"), F.col("entry_price"), F.col("exit_price"), risk)
    priced = chosen.withColumn("option_return_pct", ret)
    return priced.withColumns(
        {
            "pnl_usd": P.net_pnl(F.col("option_return_pct"), risk),
            "r_multiple": P.r_multiple(F.col("option_return_pct"), risk),
            "option_contract": F.lit(None).cast("string"),
            "option_entry_price": F.lit(None).cast("double"),
            "option_exit_price": F.lit(None).cast("double"),
            "pricing_mode": F.lit("synthetic"),
            "option_lookup_status": F.lit("synthetic"),
        }
    ).select(*TRADE_COLUMNS)


def backtest(bars: DataFrame, strategy: Strategy, risk: Risk = Risk()) -> DataFrame:
    candidates = candidate_outcomes(indexed_bars(bars, strategy), strategy.signal(), risk)
    return price_trades(non_overlapping(candidates), risk)
