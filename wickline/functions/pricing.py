"""Risk model of a trade as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wickline.params import Risk


def is_long(side: Column) -> Column:
    return side == "long"


def signed(side: Column, amount: Column) -> Column:
    """``amount`` for long, ``-amount`` for any other side."""
    return F.when(is_long(side), amount).otherwise(-amount)


def target_price(side: Column, entry: Column, risk: Risk) -> Column:
    """Price at which the option return is the target; the entry itself without
    leverage."""
    move = risk.option_target_pct / risk.option_leverage if risk.option_leverage > 0 else 0.0
    return entry * (1 + signed(side, F.lit(move)))


def stop_price(side: Column, entry: Column, atr: Column, risk: Risk) -> Column:
    return entry - signed(side, F.lit(float(risk.stop_atr_mult)) * atr)


def estimated_return(side: Column, entry: Column, exit_price: Column, risk: Risk) -> Column:
    return signed(side, (exit_price - entry) / entry) * F.lit(float(risk.option_leverage))


def net_pnl(ret: Column, risk: Risk) -> Column:
    return ret * F.lit(float(risk.capital_per_trade)) - F.lit(float(risk.commission_per_trade))


def r_multiple(ret: Column, risk: Risk) -> Column:
    if risk.option_target_pct <= 0:
        return F.lit(0.0)
    return ret / F.lit(float(risk.option_target_pct))


def trend_label(fast: Column, slow: Column) -> Column:
    return F.when(fast > slow, "Uptrend").otherwise("Downtrend")


def contract_type(side: Column) -> Column:
    return F.when(is_long(side), "call").otherwise("put")


def fallback_contract(symbol: Column, side: Column) -> Column:
    """Label of a simulated contract, used where no real one is known."""
    return F.concat(symbol, F.lit("-SIM-"), F.when(is_long(side), "C").otherwise("P"))
