"""Trades with option contracts, option prices and look-up statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickline.functions import pricing as P
from wickline.functions.clock import local_date_after, require_utc
from wickline.operators.asof import asof_prices
from wickline.operators.contracts import (
    KEY,
    kth_otm_strike,
    nearest_expiry,
    pick_contract,
    with_request,
    within_reach,
)
from wickline.operators.settle import settle
from wickline.params import Options, Risk
from wickline.plans.backtest import TRADE_COLUMNS

# Statuses of a look-up, in the order they are tested.
NO_LISTING = "reference_api_error:reference_empty"
NO_CHAIN = "no_chain_from_yahoo"
NO_EXPIRY = "no_matching_expiry"
TOO_FAR = "historical_chain_unavailable"
NO_CONTRACT = "contract_not_found"
NO_TICKER = "missing_contract_ticker"
NO_BARS_AGG = "no_price_bars:empty"
NO_BARS_CHAIN = "no_price_bars"
NO_PRICE = "missing_entry_or_exit_price"
OK = "ok"
NOT_IMPLEMENTED = ("alpaca", "marketdata")


def _prices(picks: DataFrame, quotes: DataFrame, extra_days: int, timezone: str) -> DataFrame:
    """Entry and exit quotes of the picked contract over the dates of the trade
    and ``extra_days`` more."""
    lookups = (
        picks.where("ticker is not null")
        .select(*KEY, "ticker", F.col("as_of").alias("first_date"))
        .withColumn("last_date", local_date_after(F.col("exit_time"), extra_days, timezone))
    )
    return asof_prices(lookups, quotes, KEY)


def lookup_listed(trades: DataFrame, contracts: DataFrame, quotes: DataFrame, opts: Options, timezone: str) -> DataFrame:
    """Add ``ticker``, quotes and ``status``, looked up among contracts as listed on
    the entry date; option bars up to and including the day after the exit."""
    requests = with_request(trades, opts.dte_target_days, timezone)
    listing = ["symbol", "contract_type", "as_of"]
    listings = contracts.select(F.col("underlying").alias("symbol"), "contract_type", "as_of")
    listed = listings.join(requests.select(*listing).distinct(), listing, "left_semi").distinct()
    picks = pick_contract(requests, contracts, opts.otm_steps)
    prices = _prices(picks, quotes, 1, timezone)
    found = (
        requests.join(listed.withColumn("has_listing", F.lit(True)), listing, "left")
        .join(picks.select(*KEY, "ticker", F.lit(True).alias("has_contract")), list(KEY), "left")
        .join(prices, list(KEY), "left")
    )
    status = (
        F.when(F.col("has_listing").isNull(), NO_LISTING)
        .when(F.col("has_contract").isNull(), NO_CONTRACT)
        .when(F.col("ticker").isNull(), NO_TICKER)
        .when(~F.coalesce("quoted", F.lit(False)), NO_BARS_AGG)
        .when(F.col("entry_quote").isNull() | F.col("exit_quote").isNull(), NO_PRICE)
        .otherwise(OK)
    )
    return found.withColumn("status", status)


def lookup_chain(trades: DataFrame, chain: DataFrame, quotes: DataFrame, opts: Options, timezone: str) -> DataFrame:
    """The same over one chain per expiry; option bars of the days of the trade."""
    requests = nearest_expiry(with_request(trades, opts.dte_target_days, timezone), chain, timezone)
    picks = kth_otm_strike(requests.where(within_reach()), chain, opts.otm_steps)
    picks = picks.select(*KEY, F.nullif(F.col("contract"), F.lit("")).alias("ticker"))
    prices = _prices(picks, quotes, 0, timezone)
    found = requests.join(picks, list(KEY), "left").join(prices, list(KEY), "left")
    status = (
        F.when(~F.coalesce("listed_expiries", F.lit(False)), NO_CHAIN)
        .when(F.col("expiration").isNull(), NO_EXPIRY)
        .when(~within_reach(), TOO_FAR)
        .when(F.col("ticker").isNull(), NO_CONTRACT)
        .when(~F.coalesce("quoted", F.lit(False)), NO_BARS_CHAIN)
        .when(F.col("entry_quote").isNull() | F.col("exit_quote").isNull(), NO_PRICE)
        .otherwise(OK)
    )
    return found.withColumn("status", status)


def no_lookup(trades: DataFrame, status: str) -> DataFrame:
    nothing = {"ticker": "string", "entry_quote": "double", "exit_quote": "double"}
    empty = {c: F.lit(None).cast(t) for c, t in nothing.items()}
    return trades.withColumns({**empty, "status": F.lit(status)})


def apply_lookup(found: DataFrame, provider: str) -> DataFrame:
    """Write the result of a look-up into the trade columns."""
    mode = F.when(F.col("status") == OK, f"{provider}_real").otherwise("synthetic")
    return found.withColumns(
        {
            "option_contract": F.col("ticker"),
            "option_entry_price": F.col("entry_quote"),
            "option_exit_price": F.col("exit_quote"),
            "pricing_mode": mode,
            "option_lookup_status": F.col("status"),
        }
    ).select(*TRADE_COLUMNS)


def reprice(trades: DataFrame, risk: Risk) -> DataFrame:
    """Replace the estimate by the option's own return where prices are real and
    the entry price is positive. Winning then means reaching the target return."""
    usable = (
        (F.col("option_lookup_status") == OK)
        & F.col("option_exit_price").isNotNull()
        & (F.col("option_entry_price") > 0)
    )
    real = F.col("option_exit_price") / F.nullif(F.col("option_entry_price"), F.lit(0.0)) - 1
    return (
        trades.withColumn("usable", F.coalesce(usable, F.lit(False)))
        .withColumn("real", real)
        .withColumns(
            {
                "option_return_pct": F.when(F.col("usable"), F.col("real")).otherwise(F.col("option_return_pct")),
                "pnl_usd": F.when(F.col("usable"), P.net_pnl(F.col("real"), risk)).otherwise(F.col("pnl_usd")),
                "r_multiple": F.when(F.col("usable"), P.r_multiple(F.col("real"), risk)).otherwise(F.col("r_multiple")),
                "hit_target": F.when(F.col("usable"), F.col("real") >= float(risk.option_target_pct)).otherwise(
                    F.col("hit_target")
                ),
            }
        )
        .drop("usable", "real")
    )


def real_only(trades: DataFrame, strict: bool = False) -> DataFrame:
    """Trades with real option prices. ``strict`` runs a probe and raises if there
    are none."""
    kept = trades.where(F.col("option_lookup_status") == OK)
    if strict and kept.limit(1).count() == 0:
        raise ValueError("no trade has real option prices")
    return kept


def enrich(
    trades: DataFrame,
    contracts: DataFrame | None = None,
    quotes: DataFrame | None = None,
    opts: Options = Options(),
    risk: Risk = Risk(),
    timezone: str = "America/New_York",
    strict: bool = False,
) -> DataFrame:
    """Option look-up, re-pricing and filter as ``opts`` says. ``contracts`` is the
    listing for ``polygon`` and the chain for ``yahoo``; one row per trade unless
    real prices are required. The trades are settled first: five joins read them."""
    require_utc(trades.sparkSession)
    provider = opts.provider.strip().lower()
    if provider in ("synthetic", "none"):
        return trades
    if provider == "polygon":
        found = lookup_listed(settle(trades), contracts, quotes, opts, timezone)
    elif provider == "yahoo":
        found = lookup_chain(settle(trades), contracts, quotes, opts, timezone)
    elif provider in NOT_IMPLEMENTED:
        found = no_lookup(trades, "provider_not_implemented")
    else:
        found = no_lookup(trades, f"unknown_provider:{provider}")
    enriched = apply_lookup(found, provider)
    if opts.use_real_prices_for_pnl:
        enriched = reprice(enriched, risk)
    return real_only(enriched, strict) if opts.require_real_prices else enriched
