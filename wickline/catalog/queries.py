"""One query per operator, over market tables derived from ``events``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wickline.catalog import derived
from wickline.catalog.derived import RISK, SESSION, STRATEGY
from wickline.catalog.rounding import decimals
from wickline.functions.clock import local_date_after
from wickline.operators import contracts as C
from wickline.operators import indicators as I
from wickline.operators.asof import asof_prices
from wickline.operators.blocks import with_history, with_block
from wickline.operators.outcomes import candidate_outcomes, eligible, forward_path
from wickline.operators.settle import settle, settled_path
from wickline.params import Options, Session
from wickline.plans import report
from wickline.plans.backtest import backtest, indexed_bars, signals
from wickline.plans.enrich import apply_lookup, enrich, lookup_chain, lookup_listed
from wickline.plans.strategy import BandReversal, make_signal
from wickline.sources.bars import build_bars, read_bars, session_bars
from wickline.sources.options import (
    listed_on,
    read_contract_intervals,
    read_option_bars_agg,
    read_option_bars_ohlc,
    read_option_chain,
    read_option_contracts,
)

Query = Callable[[SparkSession, str], DataFrame]

ZONE = SESSION.timezone
DAY_LONG = Session(start="00:00", end="23:59")
OPTIONS = Options(provider="polygon", use_real_prices_for_pnl=True)


def comparable(df: DataFrame) -> DataFrame:
    """Doubles rounded (without negative zero), instants as UTC wall clock."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "double":
            c = F.round(c, decimals(name)) + F.lit(0.0)
        elif kind == "timestamp":
            c = c.cast("timestamp_ntz")
        out.append(c.alias(name))
    return df.select(*out)


@dataclass
class Market:
    """The derived tables of one data directory."""

    spark: SparkSession
    sf_dir: str

    def ticks(self) -> DataFrame:
        return derived.ticks(self.spark, self.sf_dir)

    def bars(self) -> DataFrame:
        """Bars, settled: they are far fewer than the ticks, and every query over
        them reads them more than once."""
        return settle(derived.bars(self.spark, self.sf_dir))

    def minute_bars(self, session: Session) -> DataFrame:
        return settle(build_bars(self.ticks(), "1 minute", session, price="price", order="event_id"))

    def strategy(self) -> BandReversal:
        return BandReversal(STRATEGY)

    def indexed(self) -> DataFrame:
        return indexed_bars(self.bars(), self.strategy())

    def trades(self) -> DataFrame:
        return backtest(self.bars(), self.strategy(), RISK)

    def options(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Trades, raw contracts and raw option bars."""
        bars = self.bars()
        listed = derived.option_contracts(bars)
        return backtest(bars, self.strategy(), RISK), listed, derived.option_bars(listed, bars)

    def odd_options(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The same with look-ups that end in every possible way."""
        bars = self.bars()
        listed = settle(derived.odd_contracts(bars))
        return settle(backtest(bars, self.strategy(), RISK)), listed, settle(derived.odd_option_bars(listed, bars))


def bars_30m(m: Market) -> DataFrame:
    return derived.bars(m.spark, m.sf_dir)


def running_price(m: Market) -> DataFrame:
    return m.ticks()


def session_wrap(m: Market) -> DataFrame:
    night = replace(SESSION, start="20:00", end="08:00")
    bars = build_bars(m.ticks(), derived.WIDTH, night, price="price", order="event_id")
    return bars.groupBy("symbol", F.hour("local_ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume"), F.max("high").alias("high")
    )


def read_bars_range(m: Market) -> DataFrame:
    """Two symbols and two weeks of a bar table that is stored by date, every bar twice."""
    stored = derived.bars(m.spark, m.sf_dir).drop("local_ts")
    path = settled_path(stored.union(stored), by=("session_date",))
    found = read_bars(m.spark, path, symbols=["click", "purchase"], start="2024-01-05", end="2024-01-20", session=SESSION)
    return found.select("symbol", "local_ts", "open", "high", "low", "close", "volume")


def normalized_bars(m: Market) -> DataFrame:
    """Bars with two-level headers, some without a close, some with a NaN volume."""
    bars = derived.bars(m.spark, m.sf_dir)
    odd = bars.select(
        F.col("symbol").alias("Symbol"),
        F.col("ts").alias("TS"),
        *[F.col(c).alias(f"{c.title()}|X") for c in ("open", "high", "low")],
        F.when(F.col("volume") % 7 == 0, float("nan")).otherwise(F.col("close")).alias("Close|X"),
        F.when(F.col("volume") % 5 == 0, float("nan")).otherwise(F.col("volume")).alias("VOLUME"),
    )
    return session_bars(odd, SESSION).select("symbol", "local_ts", "open", "high", "low", "close", "volume")


def option_bars_ohlc(m: Market) -> DataFrame:
    """Option bars in the layout of named columns, of one week."""
    _, _, quoted = m.options()
    raw = quoted.select("ticker", F.timestamp_millis("t").alias("Ts"), F.col("c").alias("Close"))
    found = read_option_bars_ohlc(raw, ZONE, start="2024-01-08", end="2024-01-12")
    return found.groupBy("session_date").agg(
        F.count("*").alias("quotes"), F.countDistinct("ticker").alias("tickers"), F.sum("close").alias("total_close")
    )


def rolling_mean_std(m: Market) -> DataFrame:
    return I.rolling(m.bars(), "close", 20).select("symbol", "local_ts", "rolling_mean", "rolling_std")


def bollinger(m: Market) -> DataFrame:
    return I.bollinger(m.bars()).select("symbol", "local_ts", "bb_basis", "bb_upper", "bb_lower")


def ewm_mean(m: Market) -> DataFrame:
    averages = {"slow": ("high - low", 1 / 14), "fast": ("close", 0.3), "same": ("close", 1.0)}
    return I.ewm(m.bars(), averages).select("symbol", "local_ts", *averages)


def ewm_gaps(m: Market) -> DataFrame:
    """Means of a close that is missing on many bars."""
    x = "if(volume % 5 in (0, 3), null, close)"
    averages = {"slow": (x, 1 / 14), "fast": (x, 0.3), "same": (x, 1.0)}
    return I.ewm(m.bars(), averages).select("symbol", "local_ts", *averages)


def wide_bands(m: Market) -> DataFrame:
    """Bands over 500 bars of a minute, around the clock."""
    return I.bollinger(m.minute_bars(DAY_LONG), 500).select("symbol", "local_ts", "bb_basis", "bb_upper", "bb_lower")


def barrier_trades(m: Market) -> DataFrame:
    """Outcomes on one-minute bars with up to 390 bars to hold."""
    risk = replace(RISK, hold_bars=390, option_target_pct=0.2, stop_atr_mult=2.5)
    indexed = indexed_bars(m.minute_bars(SESSION), m.strategy())
    found = candidate_outcomes(indexed, m.strategy().signal(), risk)
    return found.drop("block", "entry_time", "exit_time")


def ema_10_20(m: Market) -> DataFrame:
    return I.ema(m.bars(), {"ema10": 10, "ema20": 20}).select("symbol", "local_ts", "ema10", "ema20")


def gain_loss(m: Market) -> DataFrame:
    return I.changes(m.bars()).select("symbol", "local_ts", "prev_close", "delta", "gain", "loss")


def rsi(m: Market) -> DataFrame:
    return I.rsi(m.bars()).select("symbol", "local_ts", "rsi")


def true_range_atr(m: Market) -> DataFrame:
    return I.atr(m.bars()).select("symbol", "local_ts", "tr", "atr")


def rel_volume(m: Market) -> DataFrame:
    return I.relative_volume(m.bars()).select("symbol", "local_ts", "volume_sma", "rel_volume")


PREPARED = (
    "symbol", "local_ts", "open", "high", "low", "close", "volume", "bb_basis", "bb_upper", "bb_lower",
    "rsi", "atr", "volume_sma", "rel_volume", "ema10", "ema20",
)


def prepared(m: Market) -> DataFrame:
    return m.indexed().select(*PREPARED, "bar_idx", F.col("bar_idx_total").alias("bars"))


def signals_(m: Market) -> DataFrame:
    found = signals(m.bars(), m.strategy())
    return found.select(
        "symbol", "local_ts", "bar_idx", "close", "rsi", "side", "reason", eligible(RISK.hold_bars).alias("eligible")
    )


def volume_gate(m: Market) -> DataFrame:
    gated = BandReversal(replace(STRATEGY, min_rel_volume=1.2))
    return signals(m.bars(), gated).groupBy("symbol", "side").agg(F.count(F.lit(1)).alias("signals"))


def volume_gate_level(m: Market) -> DataFrame:
    """Signals that need a busy average as well."""
    gated = BandReversal(replace(STRATEGY, min_rel_volume=0.8, min_volume_sma=1.4))
    return signals(m.bars(), gated).groupBy("symbol", "side").agg(F.count(F.lit(1)).alias("signals"))


def eligible_signals(m: Market) -> DataFrame:
    """Signals on one-minute bars that leave room for 390 more, and those that don't."""
    found = signals(m.minute_bars(SESSION), m.strategy())
    return found.select("symbol", "local_ts", "bar_idx", eligible(390).alias("eligible"))


def forward_path_(m: Market) -> DataFrame:
    indexed = settle(m.indexed())
    found = indexed.where(m.strategy().signal().isNotNull())
    return forward_path(found, indexed, RISK.hold_bars)


def candidate_outcomes_(m: Market) -> DataFrame:
    found = candidate_outcomes(m.indexed(), m.strategy().signal(), RISK)
    return found.drop("block", "entry_time", "exit_time")


def trades(m: Market) -> DataFrame:
    return m.trades().drop("option_contract", "option_entry_price", "option_exit_price")


def long_hold_trades(m: Market) -> DataFrame:
    return backtest(m.bars(), m.strategy(), replace(RISK, hold_bars=8, stop_atr_mult=2.5, option_target_pct=0.2)).select(
        "symbol", "entry_idx", "exit_idx", "side", "exit_reason", "bars_held", "pnl_usd", "r_multiple"
    )


@dataclass(frozen=True)
class CrossUp:
    """A strategy that knows nothing of blocks: long when the close crosses the
    slow average upwards. Its look-back is a column added in ``prepare``."""

    name: str = "cross_up"

    def prepare(self, bars: DataFrame) -> DataFrame:
        averaged = I.ema(bars, {"ema10": 10, "ema20": 20})
        history = with_history(with_block(averaged), 1)
        above = F.col("close") > F.col("ema20")
        before = F.expr("lag(close > ema20) over (partition by symbol, block order by ts)")
        crossed = history.withColumn("crossed", above & ~before)
        return crossed.where(~F.col("is_history")).drop("is_history")

    def signal(self) -> Column:
        return F.when(F.col("crossed"), make_signal("long", "close_crossed_above_slow_average"))


def custom_strategy_trades(m: Market) -> DataFrame:
    return backtest(m.bars(), CrossUp(), RISK).select(
        "symbol", "entry_local", "entry_idx", "exit_idx", "side", "exit_reason", "pnl_usd", "trend"
    )


def summary(m: Market) -> DataFrame:
    return report.summary(m.trades())


def summary_by_symbol(m: Market) -> DataFrame:
    return report.summary(m.trades(), ("symbol", "side"))


def summary_by_trend(m: Market) -> DataFrame:
    return report.summary_by_trend(m.trades())


def _requests(trades: DataFrame) -> DataFrame:
    return C.with_request(settle(trades), OPTIONS.dte_target_days, ZONE)


def contracts_candidates(m: Market) -> DataFrame:
    made, listed, _ = m.options()
    found = C.contract_candidates(_requests(made), read_option_contracts(listed))
    return found.select("symbol", "entry_time", "expiration", "qualifying")


def _rank_k(otm_steps: int) -> Callable[[Market], DataFrame]:
    def query(m: Market) -> DataFrame:
        made, listed, _ = m.options()
        found = C.pick_contract(_requests(made), read_option_contracts(listed), otm_steps)
        return found.select("symbol", "entry_time", "expiration", "strike", "ticker")

    return query


def contracts_by_interval(m: Market) -> DataFrame:
    """The contract of each trade among listings with a first and a last day."""
    made, listed, _ = m.odd_options()
    by = ["underlying", "contract_type", "expiration_date", "strike_price"]
    spans = listed.groupBy(*by).agg(F.min("ticker").alias("ticker"), F.min("as_of").alias("listed_from"), F.max("as_of").alias("listed_to"))
    requests = C.with_request(made, OPTIONS.dte_target_days, ZONE)
    found = C.pick_contract(requests, listed_on(read_contract_intervals(spans), requests), 1)
    return found.select("symbol", "entry_time", "expiration", "strike", "ticker")


def _chain_requests(made: DataFrame, chain: DataFrame) -> DataFrame:
    return C.nearest_expiry(_requests(made), chain, ZONE)


def nearest_expiry(m: Market) -> DataFrame:
    made, listed, _ = m.options()
    found = _chain_requests(made, read_option_chain(derived.option_chain(listed)))
    return found.select(
        "symbol", "entry_time", "wanted", "expiration", "days_to_expiry", C.within_reach().alias("within_reach")
    )


def _kth_strike(otm_steps: int) -> Callable[[Market], DataFrame]:
    def query(m: Market) -> DataFrame:
        made, listed, _ = m.options()
        chain = read_option_chain(derived.option_chain(listed))
        found = C.kth_otm_strike(_chain_requests(made, chain), chain, otm_steps)
        return found.select("symbol", "entry_time", "expiration", "strike", "contract")

    return query


def asof_price(m: Market) -> DataFrame:
    made, listed, quoted = m.options()
    made = settle(made)
    picks = C.pick_contract(C.with_request(made, OPTIONS.dte_target_days, ZONE), read_option_contracts(listed), 2).where("ticker is not null")
    lookups = made.select(
        "symbol",
        "entry_time",
        "exit_time",
        F.col("session_date").alias("first_date"),
        local_date_after(F.col("exit_time"), 1, ZONE).alias("last_date"),
    ).join(picks.select("symbol", "entry_time", "ticker"), ["symbol", "entry_time"])
    return asof_prices(lookups, read_option_bars_agg(quoted, ZONE))


STATUS = ("symbol", "entry_time", "option_contract", "option_entry_price", "option_exit_price", "pricing_mode", "option_lookup_status")


def lookup_status_agg(m: Market) -> DataFrame:
    made, listed, quoted = m.options()
    found = lookup_listed(settle(made), read_option_contracts(listed), read_option_bars_agg(quoted, ZONE), OPTIONS, ZONE)
    return apply_lookup(found, "polygon").select(*STATUS)


def lookup_status_chain(m: Market) -> DataFrame:
    made, listed, quoted = m.options()
    chain = read_option_chain(derived.option_chain(listed))
    found = lookup_chain(settle(made), chain, read_option_bars_agg(quoted, ZONE), OPTIONS, ZONE)
    return apply_lookup(found, "yahoo").select(*STATUS)


def lookup_branches_agg(m: Market) -> DataFrame:
    """Every status of the look-up among listings."""
    made, listed, quoted = m.odd_options()
    found = lookup_listed(made, read_option_contracts(listed), read_option_bars_agg(quoted, ZONE), OPTIONS, ZONE)
    return apply_lookup(found, "polygon").select(*STATUS)


def lookup_branches_chain(m: Market) -> DataFrame:
    """Every status of the look-up in chains."""
    made, listed, quoted = m.odd_options()
    chain = read_option_chain(derived.option_chain(listed))
    found = lookup_chain(made, chain, read_option_bars_agg(quoted, ZONE), OPTIONS, ZONE)
    return apply_lookup(found, "yahoo").select(*STATUS)


def nearest_expiry_varied(m: Market) -> DataFrame:
    """Expiries near, far and missing."""
    made, listed, _ = m.odd_options()
    found = C.nearest_expiry(C.with_request(made, OPTIONS.dte_target_days, ZONE), read_option_chain(derived.option_chain(listed)), ZONE)
    return found.select("symbol", "entry_time", "wanted", "expiration", "days_to_expiry", C.within_reach().alias("within_reach"))


def repriced_chain(m: Market) -> DataFrame:
    """Trades enriched from chains, with real prices where there are."""
    made, listed, quoted = m.odd_options()
    chain = read_option_chain(derived.option_chain(listed))
    opts = replace(OPTIONS, provider="yahoo")
    return enrich(made, chain, read_option_bars_agg(quoted, ZONE), opts, RISK, ZONE).select(*REPRICED)


def _enriched(m: Market, opts: Options) -> DataFrame:
    made, listed, quoted = m.options()
    return enrich(made, read_option_contracts(listed), read_option_bars_agg(quoted, ZONE), opts, RISK, ZONE)


REPRICED = ("symbol", "entry_time", "option_return_pct", "pnl_usd", "r_multiple", "hit_target", "exit_reason", "pricing_mode", "option_lookup_status")


def repriced_trades(m: Market) -> DataFrame:
    return _enriched(m, OPTIONS).select(*REPRICED)


def real_only(m: Market) -> DataFrame:
    return _enriched(m, replace(OPTIONS, require_real_prices=True)).select(*REPRICED)


def enriched_summary(m: Market) -> DataFrame:
    return report.summary(_enriched(m, OPTIONS), ("trend", "pricing_mode"))


def unimplemented_provider(m: Market) -> DataFrame:
    made = settle(m.trades())
    known = enrich(made, opts=Options(provider="alpaca"))
    unknown = enrich(made, opts=Options(provider=" Other "))
    unchanged = enrich(made, opts=Options(provider="synthetic", require_real_prices=True))
    every = known.unionByName(unknown).unionByName(unchanged)
    return every.groupBy("pricing_mode", "option_lookup_status").agg(F.count(F.lit(1)).alias("trades"))


def trade_log(m: Market) -> DataFrame:
    return report.trade_log(_enriched(m, OPTIONS))


def trade_log_overall(m: Market) -> DataFrame:
    return report.trade_log(m.trades(), overall=True).select(
        "trade_id", "symbol", "entry_time", "option_contract", "signal_reason", "underlying_exit_price"
    )


def display_log(m: Market) -> DataFrame:
    return report.display_log(_enriched(m, OPTIONS))


def example_trades(m: Market) -> DataFrame:
    return report.example_trades(m.trades(), 3).select(
        "symbol", "example", "entry_local", "hit_target", "side", "pnl_usd"
    )


def trade_context(m: Market) -> DataFrame:
    bars = m.bars()
    examples = report.example_trades(backtest(bars, m.strategy(), RISK), 2)
    return report.trade_context(examples, indexed_bars(bars, m.strategy()))


def trade_context_marks(m: Market) -> DataFrame:
    """The bars around the example trades with what labels them."""
    bars = m.bars()
    examples = report.example_trades(backtest(bars, m.strategy(), RISK), 2)
    found = report.trade_context(examples, indexed_bars(bars, m.strategy()), around=5, marks=True)
    return found.drop("bb_upper", "bb_basis", "bb_lower", "rsi")


def summary_text(m: Market) -> DataFrame:
    """The summary as text, of trades large enough for thousands."""
    large = replace(RISK, capital_per_trade=250_000.0, option_leverage=2_000.0)
    return report.display_summary(backtest(m.bars(), m.strategy(), large), ("symbol",))


QUERIES: dict[str, Callable[[Market], DataFrame]] = {
    "running_price": running_price,
    "bars_30m": bars_30m,
    "session_wrap": session_wrap,
    "read_bars_range": read_bars_range,
    "normalized_bars": normalized_bars,
    "option_bars_ohlc": option_bars_ohlc,
    "rolling_mean_std": rolling_mean_std,
    "bollinger": bollinger,
    "ewm_mean": ewm_mean,
    "ewm_gaps": ewm_gaps,
    "wide_bands": wide_bands,
    "ema_10_20": ema_10_20,
    "gain_loss": gain_loss,
    "rsi": rsi,
    "true_range_atr": true_range_atr,
    "rel_volume": rel_volume,
    "prepared": prepared,
    "signals": signals_,
    "volume_gate": volume_gate,
    "volume_gate_level": volume_gate_level,
    "eligible_signals": eligible_signals,
    "forward_path": forward_path_,
    "candidate_outcomes": candidate_outcomes_,
    "trades": trades,
    "long_hold_trades": long_hold_trades,
    "barrier_trades": barrier_trades,
    "custom_strategy_trades": custom_strategy_trades,
    "summary": summary,
    "summary_by_symbol": summary_by_symbol,
    "summary_by_trend": summary_by_trend,
    "contracts_candidates": contracts_candidates,
    "contract_rank_k": _rank_k(1),
    "contract_rank_spill": _rank_k(9),
    "contract_rank_clamp": _rank_k(99),
    "contracts_by_interval": contracts_by_interval,
    "nearest_expiry": nearest_expiry,
    "kth_otm_strike": _kth_strike(1),
    "kth_otm_strike_clamp": _kth_strike(99),
    "asof_price": asof_price,
    "lookup_status_agg": lookup_status_agg,
    "lookup_branches_agg": lookup_branches_agg,
    "lookup_branches_chain": lookup_branches_chain,
    "nearest_expiry_varied": nearest_expiry_varied,
    "repriced_chain": repriced_chain,
    "lookup_status_chain": lookup_status_chain,
    "repriced_trades": repriced_trades,
    "real_only": real_only,
    "enriched_summary": enriched_summary,
    "unimplemented_provider": unimplemented_provider,
    "trade_log": trade_log,
    "trade_log_overall": trade_log_overall,
    "display_log": display_log,
    "example_trades": example_trades,
    "trade_context": trade_context,
    "trade_context_marks": trade_context_marks,
    "summary_text": summary_text,
}


def registered() -> dict[str, Query]:
    def bind(build: Callable[[Market], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return comparable(build(Market(spark, sf_dir)))

        return run

    return {name: bind(build) for name, build in QUERIES.items()}
