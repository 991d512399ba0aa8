"""Named indicators over a bar table, each usable on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickline.operators import rolling as R
from wickline.operators.blocks import with_block, with_history
from wickline.operators.scan import scan_series, span_alpha, wilder_alpha


def _looking_back(bars: DataFrame, rows: int, columns: dict[str, Column]) -> DataFrame:
    """Evaluate look-back columns with ``rows`` rows of history, then drop it."""
    framed = with_history(with_block(bars), rows).withColumns(columns)
    return framed.where(~F.col("is_history")).drop("is_history")


def bollinger(bars: DataFrame, length: int = 20, width: float = 2.0) -> DataFrame:
    named = rolling(bars, "close", length).withColumnsRenamed({"rolling_mean": "bb_basis", "rolling_std": "sigma"})
    return add_bands(named, width)


def add_bands(df: DataFrame, width: float) -> DataFrame:
    reach = F.lit(float(width)) * F.col("sigma")
    return df.withColumns({"bb_upper": F.col("bb_basis") + reach, "bb_lower": F.col("bb_basis") - reach}).drop("sigma")


def rolling(bars: DataFrame, value: str, length: int) -> DataFrame:
    """Rolling mean and population deviation of one column."""
    framed = R.add_frame(with_history(with_block(bars), length - 1), value, length, "frame")
    full = {f"rolling_{m}": R.where_full("frame_full", f"frame_{m}") for m in ("mean", "std")}
    own = framed.where(~F.col("is_history")).withColumns(full)
    return own.drop("is_history", "block", "frame_full", "frame_mean", "frame_std")


def changes(bars: DataFrame) -> DataFrame:
    """Previous close, its difference, and the gain / loss split."""
    framed = _looking_back(bars, 1, {"prev_close": R.previous(F.col("close"))})
    return framed.selectExpr("*", "close - prev_close as delta", f"{R.GAIN} as gain", f"{R.LOSS} as loss")


def ewm(bars: DataFrame, averages: dict[str, tuple[str, float]], levels: tuple[str, ...] = ()) -> DataFrame:
    """Exponentially weighted means, ``{name: (SQL expression, alpha)}``. Missing values
    may come anywhere: a mean stays over them, and its weight decays with each."""
    return scan_series(with_block(bars), averages, levels=levels, holes=tuple(averages)).drop("block")


def ema(bars: DataFrame, spans: dict[str, int], value: str = "close") -> DataFrame:
    return ewm(bars, {name: (value, span_alpha(n)) for name, n in spans.items()}, levels=tuple(spans))


def rsi(bars: DataFrame, length: int = 14) -> DataFrame:
    a = wilder_alpha(length)
    averaged = scan_series(changes(bars), {"avg_gain": ("gain", a), "avg_loss": ("loss", a)})
    return averaged.withColumn("rsi", R.relative_strength(F.col("avg_gain"), F.col("avg_loss"))).drop("block")


def atr(bars: DataFrame, length: int = 14) -> DataFrame:
    ranged = changes(bars).selectExpr("*", f"{R.TRUE_RANGE} as tr")
    return scan_series(ranged, {"atr": ("tr", wilder_alpha(length))}).drop("block")


def relative_volume(bars: DataFrame, length: int = 20) -> DataFrame:
    averaged = rolling(bars, "volume", length).withColumnRenamed("rolling_mean", "volume_sma").drop("rolling_std")
    return averaged.withColumn("rel_volume", R.relative_volume(F.col("volume"), F.col("volume_sma")))
