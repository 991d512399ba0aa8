"""Strategies: indicator columns plus a per-bar signal, both as expressions."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickline.operators import rolling as R
from wickline.operators.blocks import with_block, with_history
from wickline.operators.indicators import add_bands
from wickline.operators.scan import scan_series, span_alpha, wilder_alpha
from wickline.params import ReversalParams

# Reasons of the reversal signals as they appear in the trade log.
LONG_REASON = "close_below_lower_bb_rsi_oversold_volume_confirmed"
SHORT_REASON = "close_above_upper_bb_rsi_overbought_volume_confirmed"


class Strategy(Protocol):
    """What a backtest needs to know about a strategy.

    ``prepare`` adds columns to a bar table; look-back is a window or a column
    added there. ``signal`` judges one prepared row and returns a struct
    ``(side, reason)``, null for no signal. ``prepare`` must keep the bar columns
    and add ``ema10`` and ``ema20``, the trend context; ``atr`` is optional. It may
    add ``block`` and ``bar_idx`` / ``bar_idx_total`` if it numbers complete rows
    itself, which saves a pass.

    Logic that no column expression can state may use
    ``groupBy("symbol", "block").applyInPandas`` inside ``prepare``.
    """

    name: str

    def prepare(self, bars: DataFrame) -> DataFrame: ...

    def signal(self) -> Column: ...


def make_signal(side: str, reason: str) -> Column:
    return F.struct(F.lit(side).alias("side"), F.lit(reason).alias("reason"))


@dataclass(frozen=True)
class BandReversal:
    """Fade a close outside the bands when RSI and volume agree."""

    params: ReversalParams = ReversalParams()
    name: str = "bollinger_rsi_reversal"

    def prepare(self, bars: DataFrame) -> DataFrame:
        p = self.params
        close, volume = F.col("close"), F.col("volume")
        lookback = max(p.bb_length - 1, p.volume_ma_length - 1, 1)
        history = with_history(with_block(bars), lookback).withColumn("prev_close", R.previous(close))
        framed = R.add_frame(R.add_frame(history, "close", p.bb_length, "bands"), "volume", p.volume_ma_length, "busy")
        framed = (
            framed
            .where(~F.col("is_history"))
            .select(
                *bars.columns,
                "block",
                F.col("bands_full").alias("bands_known"),
                R.where_full("bands_full", "bands_mean").alias("bb_basis"),
                R.where_full("bands_full", "bands_std").alias("sigma"),
                R.where_full("busy_full", "busy_mean").alias("volume_sma"),
                F.expr(R.GAIN).alias("gain"),
                F.expr(R.LOSS).alias("loss"),
                F.expr(R.TRUE_RANGE).alias("tr"),
            )
        )
        # A row is complete if the bar is and both look-backs are. Naming every bar
        # column also keeps the two passes of the scan on the same columns, hence on
        # one shuffle of the bars; naming no band keeps the deviation out of the first.
        complete = " and ".join(["bands_known", "volume_sma <> 0", *[f"{c} is not null" for c in bars.columns]])
        strength = wilder_alpha(p.rsi_length)
        scanned = scan_series(
            framed,
            averages={
                "avg_gain": ("gain", strength),
                "avg_loss": ("loss", strength),
                "atr": ("tr", wilder_alpha(p.atr_length)),
                "ema10": ("close", span_alpha(10)),
                "ema20": ("close", span_alpha(20)),
            },
            ordinals={"bar_idx": complete},
            levels=("ema10", "ema20"),
        )
        measured = scanned.withColumns(
            {
                "rsi": R.relative_strength(F.col("avg_gain"), F.col("avg_loss")),
                "rel_volume": R.relative_volume(volume, F.col("volume_sma")),
            }
        )
        return add_bands(measured, p.bb_std).drop("bands_known", "gain", "loss", "tr", "avg_gain", "avg_loss")

    def signal(self) -> Column:
        p = self.params
        # Comparisons with null never hold; only the band not compared is named.
        busy = f"rel_volume >= {p.min_rel_volume}D and volume_sma >= {p.min_volume_sma}D"
        fell = f"bb_upper is not null and close < bb_lower and rsi <= {p.rsi_oversold}D"
        rose = f"bb_lower is not null and close > bb_upper and rsi >= {p.rsi_overbought}D"
        buy_call = F.when(F.expr(f"{busy} and {fell}"), make_signal("long", LONG_REASON))
        return buy_call.when(F.expr(f"{busy} and {rose}"), make_signal("short", SHORT_REASON))
