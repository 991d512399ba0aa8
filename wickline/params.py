"""Parameters of a run, with the defaults a plain run uses."""

from __future__ import annotations

from dataclasses import dataclass

# The names and defaults of all parameters below.


@dataclass(frozen=True)
class Session:
    """Trading session: a time zone and the wall-clock range [start, end)."""

    timezone: str = "America/New_York"
    start: str = "09:30"
    end: str = "16:00"


@dataclass(frozen=True)
class Risk:
    capital_per_trade: float = 1000.0
    option_target_pct: float = 0.05
    hold_bars: int = 3
    option_leverage: float = 20.0
    stop_atr_mult: float = 1.0
    commission_per_trade: float = 0.0


@dataclass(frozen=True)
class ReversalParams:
    """Bands, oscillators and gates of the band/RSI reversal strategy."""

    bb_length: int = 20
    bb_std: float = 2.0
    rsi_length: int = 14
    atr_length: int = 14
    volume_ma_length: int = 20
    rsi_oversold: float = 35.0
    rsi_overbought: float = 65.0
    min_rel_volume: float = 1.2
    min_volume_sma: float = 1_000_000.0


@dataclass(frozen=True)
class Options:
    """How option prices are looked up and used.

    ``provider`` is ``synthetic``/``none`` (no look-up), ``polygon`` (contracts
    as listed on the entry date) or ``yahoo`` (one chain per expiry).
    """

    provider: str = "yahoo"
    dte_target_days: int = 2
    otm_steps: int = 1
    use_real_prices_for_pnl: bool = False
    require_real_prices: bool = False
