"""Contract choice, as-of prices, statuses and re-pricing on hand cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wickline.operators import contracts as C
from wickline.operators.asof import asof_prices
from wickline.params import Options, Risk
from wickline.plans.enrich import enrich, real_only, reprice
from wickline.sources.options import (
    read_option_bars_agg,
    read_option_bars_ohlc,
    read_option_chain,
    read_option_contracts,
)

ZONE = "America/New_York"
DAY = dt.date(2024, 3, 4)
UTC = dt.timezone.utc


def at(hour, minute=0, day=4):
    """New York wall clock in March before the clock change."""
    return dt.datetime(2024, 3, day, hour + 5, minute, tzinfo=UTC)


TRADES = (
    "symbol string, session_date date, entry_idx long, exit_idx long, entry_time timestamp, exit_time timestamp, "
    "entry_local timestamp_ntz, exit_local timestamp_ntz, side string, entry_price double, exit_price double, "
    "bars_held int, hit_target boolean, option_return_pct double, pnl_usd double, r_multiple double, trend string, "
    "reason string, exit_reason string, option_contract string, option_entry_price double, option_exit_price double, "
    "pricing_mode string, option_lookup_status string"
)


def trade(symbol="X", side="long", spot=100.0, entry=at(10), exit_=at(10, 15), idx=0, status="synthetic", real=(None, None)):
    local = lambda t: t.replace(tzinfo=None) - dt.timedelta(hours=5)
    return (
        symbol, local(entry).date(), idx, idx + 3, entry, exit_, local(entry), local(exit_), side, spot, spot, 3, False,
        0.01, 10.0, 0.2, "Uptrend", "r", "time_exit", None, *real, "synthetic", status,
    )


@pytest.fixture
def make_trades(spark):
    return lambda *rows: spark.createDataFrame(list(rows), TRADES)


CONTRACTS = "underlying string, contract_type string, as_of date, expiration_date string, strike_price string, ticker string"


def contract(exp, strike, ticker="auto", kind="call", symbol="X", as_of=DAY):
    name = f"{kind[0]}{exp[-2:]}-{strike}" if ticker == "auto" else ticker
    return (symbol, kind, as_of, exp, str(strike) if strike is not None else None, name)


@pytest.fixture
def make_contracts(spark):
    return lambda *rows: read_option_contracts(spark.createDataFrame(list(rows), CONTRACTS))


def picked(trades, contracts, k=1, dte=2):
    requests = C.with_request(trades, dte, ZONE)
    return {(r.symbol, r.entry_time): r.ticker for r in C.pick_contract(requests, contracts, k).collect()}


def only(found):
    (value,) = found.values()
    return value


def test_strike_at_spot_serves_both_sides(make_trades, make_contracts):
    listed = [contract("2024-03-06", s, kind=k) for s in (99, 100, 101) for k in ("call", "put")]
    assert only(picked(make_trades(trade(side="long")), make_contracts(*listed))) == "c06-100"
    assert only(picked(make_trades(trade(side="short")), make_contracts(*listed))) == "p06-100"


@pytest.mark.parametrize("k,want", [(0, "c06-101"), (1, "c06-101"), (2, "c06-105"), (3, "c05-102"), (4, "c07-101"), (99, "c18-100.5")])
def test_steps_spill_over_expiries_and_clamp(make_trades, make_contracts, k, want):
    listed = make_contracts(
        contract("2024-03-06", 105), contract("2024-03-06", 101), contract("2024-03-06", 99),
        contract("2024-03-05", 102), contract("2024-03-07", 101), contract("2024-03-18", 100.5),
        contract("2024-03-19", 101), contract("2024-03-06", 101, kind="put"),
        contract("2024-03-06", 101, symbol="Y", ticker="other"), contract("2024-03-06", 101, as_of=dt.date(2024, 3, 3), ticker="old"),
    )
    assert only(picked(make_trades(trade()), listed, k)) == want


def test_unreadable_rows_are_skipped(make_trades, make_contracts):
    listed = make_contracts(
        contract("soon", 100), contract("2024-03-06", "cheap"), contract("2024-03-06", None), contract("2024-03-06", 104)
    )
    assert only(picked(make_trades(trade()), listed)) == "c06-104"


def test_rank_choice_equals_brute_force(spark, make_trades, make_contracts):
    import random

    rng = random.Random(5)
    listed = [
        contract(f"2024-03-{d:02d}", rng.randint(180, 220) / 2, ticker=f"T{i}", kind=rng.choice(("call", "put")))
        for i, d in enumerate(rng.randint(4, 18) for _ in range(150))
    ]
    rows = [trade(side=rng.choice(("long", "short")), spot=rng.randint(185, 215) / 2, entry=at(10, i), idx=i) for i in range(40)]
    for k in (1, 3, 500):
        want = {}
        for t in rows:
            kind = "call" if t[8] == "long" else "put"
            ok = [c for c in listed if c[1] == kind and (float(c[4]) >= t[9] if kind == "call" else float(c[4]) <= t[9])]
            gap = lambda c: abs((dt.date.fromisoformat(c[3]) - dt.date(2024, 3, 6)).days)
            ok.sort(key=lambda c: (gap(c), c[3], abs(float(c[4]) - t[9]), c[5]))
            want[("X", t[4].replace(tzinfo=None))] = ok[min(k - 1, len(ok) - 1)][5]
        assert picked(make_trades(*rows), make_contracts(*listed).repartition(4), k) == want


CHAIN = "underlying string, contract_type string, expiration string, strike double, contractSymbol string"


def make_chain(spark, *rows):
    return read_option_chain(spark.createDataFrame(list(rows), CHAIN))


def test_nearest_expiry_and_distance(spark, make_trades):
    chain = make_chain(spark, ("X", "call", "2024-03-05", 1.0, "a"), ("X", "put", "2024-03-15", 1.0, "b"),
                       ("X", "call", "2024-03-16", 1.0, "c"), ("Y", "call", "2024-03-01", 1.0, "d"))
    rows = [trade(), trade(entry=at(10, day=14), idx=1), trade(entry=at(10, day=15), idx=2), trade("Y", idx=3), trade("Z", idx=4)]
    requests = C.with_request(make_trades(*rows), 2, ZONE)
    got = C.nearest_expiry(requests, chain, ZONE).withColumn("near", C.within_reach()).collect()
    by = {(r.symbol, r.entry_local.day): (r.expiration and r.expiration.day, r.days_to_expiry, r.near, r.listed_expiries) for r in got}
    assert by[("X", 4)] == (15, 10, True, True)
    assert by[("X", 14)] == (16, 1, True, True)
    assert by[("X", 15)] == (None, None, None, True)
    assert by[("Y", 4)] == (None, None, None, True)
    assert by[("Z", 4)] == (None, None, None, False)


def test_expiry_eleven_days_out_passes_and_twelve_does_not(spark, make_trades):
    for day, near in ((15, True), (16, False)):
        chain = make_chain(spark, ("X", "call", f"2024-03-{day}", 100.0, "a"))
        requests = C.with_request(make_trades(trade(entry=at(10, day=4))), 2, ZONE)
        (r,) = C.nearest_expiry(requests, chain, ZONE).withColumn("near", C.within_reach()).collect()
        assert r.near is near


@pytest.mark.parametrize("side,k,want", [("long", 1, "c100"), ("long", 2, "c102"), ("long", 9, "c105"), ("short", 1, "p100"), ("short", 2, "p98"), ("short", 9, "p95")])
def test_kth_distinct_strike(spark, make_trades, side, k, want):
    rows = [("X", kind, "2024-03-06", float(s), f"{kind[0]}{s}") for kind in ("call", "put") for s in (95, 98, 100, 102, 105)]
    rows += [("X", "call", "2024-03-06", 100.0, "c100b"), ("X", "put", "2024-03-06", 100.0, "p100b")]
    chain = make_chain(spark, *rows)
    requests = C.nearest_expiry(C.with_request(make_trades(trade(side=side)), 2, ZONE), chain, ZONE)
    (r,) = C.kth_otm_strike(requests, chain, k).collect()
    assert r.contract == want


def quotes(spark, *rows):
    raw = spark.createDataFrame([(t, int(ts.timestamp() * 1000), c) for t, ts, c in rows], "ticker string, t long, c double")
    return read_option_bars_agg(raw, ZONE)


def lookup(spark, entry, exit_, ticker="T", last=dt.date(2024, 3, 5)):
    schema = "symbol string, entry_time timestamp, exit_time timestamp, ticker string, first_date date, last_date date"
    return spark.createDataFrame([("X", entry, exit_, ticker, DAY, last)], schema)


@pytest.mark.parametrize(
    "entry,exit_,want",
    [
        (at(9), at(10), (1.0, 1.0)),  # before the first, exact
        (at(10, 1), at(10, 30), (2.0, 2.0)),  # between, exact
        (at(11), at(12), (3.0, 3.0)),  # nothing later that day: the next day's first
    ],
)
def test_price_at_or_after(spark, entry, exit_, want):
    q = quotes(spark, ("T", at(10), 1.0), ("T", at(10, 30), 2.0), ("T", at(10, day=5), 3.0), ("T", at(10, day=6), 9.0), ("U", at(11), 8.0))
    (r,) = asof_prices(lookup(spark, entry, exit_), q).collect()
    assert (r.entry_quote, r.exit_quote, r.quoted) == (*want, True)


def test_price_before_and_none(spark):
    q = quotes(spark, ("T", at(10), 1.0), ("T", at(10, 30), 2.0), ("T", at(10, day=5), 3.0))
    (r,) = asof_prices(lookup(spark, at(11), at(12), last=DAY), q).collect()
    assert (r.entry_quote, r.exit_quote) == (2.0, 2.0)
    (r,) = asof_prices(lookup(spark, at(11), at(12), ticker="V"), q).collect()
    assert (r.entry_quote, r.exit_quote, r.quoted) == (None, None, False)


def test_statuses_of_the_listed_lookup(spark, make_trades, make_contracts):
    listed = make_contracts(
        contract("2024-03-06", 101, symbol="OK"), contract("2024-03-06", 99, symbol="BELOW"),
        contract("2024-03-06", 101, symbol="NOTICK", ticker=None), contract("2024-03-06", 101, symbol="NOBARS", ticker="quiet"),
        contract("bad", 101, symbol="BAD"), contract("2024-03-06", 101, symbol="NULLPX", ticker="nul"),
    )
    q = quotes(spark, ("c06-101", at(10), 1.0), ("c06-101", at(10, 15), 1.5), ("quiet", at(10, day=6), 1.0), ("nul", at(10), None))
    names = ("OK", "BELOW", "NOTICK", "NOBARS", "BAD", "NULLPX", "NOTHING")
    made = make_trades(*[trade(n) for n in names])
    got = {r.symbol: r for r in enrich(made, listed, q, Options(provider="Polygon ")).collect()}
    status = {s: r.option_lookup_status for s, r in got.items()}
    assert status == {
        "OK": "ok",
        "BELOW": "contract_not_found",
        "NOTICK": "missing_contract_ticker",
        "NOBARS": "no_price_bars:empty",
        "BAD": "contract_not_found",
        "NULLPX": "missing_entry_or_exit_price",
        "NOTHING": "reference_api_error:reference_empty",
    }
    assert got["OK"].pricing_mode == "polygon_real" and got["BELOW"].pricing_mode == "synthetic"
    assert got["NOBARS"].option_contract == "quiet"
    assert (got["OK"].option_entry_price, got["OK"].option_exit_price) == (1.0, 1.5)
    assert got["OK"].pnl_usd == 10.0


def test_statuses_of_the_chain_lookup(spark, make_trades):
    chain = make_chain(
        spark, ("OK", "call", "2024-03-06", 101.0, "a"), ("OLD", "call", "2024-03-05", 101.0, "b"),
        ("FAR", "call", "2024-03-17", 101.0, "c"), ("BELOW", "call", "2024-03-06", 99.0, "d"),
        ("NOBARS", "call", "2024-03-06", 101.0, "e"),
    )
    q = quotes(spark, ("a", at(10), 1.0), ("a", at(10, 15), 1.5), ("e", at(10, day=5), 1.0))
    made = make_trades(*[trade(n) for n in ("OK", "OLD", "FAR", "BELOW", "NOBARS", "NONE")])
    got = {r.symbol: r.option_lookup_status for r in enrich(made, chain, q, Options()).collect()}
    assert got == {
        "OK": "ok",
        "OLD": "no_matching_expiry",
        "FAR": "historical_chain_unavailable",
        "BELOW": "contract_not_found",
        "NOBARS": "no_price_bars",
        "NONE": "no_chain_from_yahoo",
    }


def test_repricing(make_trades):
    made = make_trades(
        trade("WIN", status="ok", real=(2.0, 2.1)), trade("LOSE", status="ok", real=(2.0, 1.0)),
        trade("FREE", status="ok", real=(0.0, 1.0)), trade("EST", status="contract_not_found", real=(2.0, 4.0)),
    )
    got = {r.symbol: r for r in reprice(made, Risk(commission_per_trade=1.0)).collect()}
    assert got["WIN"].option_return_pct == pytest.approx(0.05) and got["WIN"].pnl_usd == pytest.approx(49.0)
    assert got["WIN"].hit_target is (2.1 / 2.0 - 1 >= 0.05)
    assert got["LOSE"].r_multiple == pytest.approx(-10.0) and not got["LOSE"].hit_target
    for name in ("FREE", "EST"):
        assert (got[name].option_return_pct, got[name].pnl_usd) == (0.01, 10.0)
    assert [r.symbol for r in real_only(made).orderBy("symbol").collect()] == ["FREE", "LOSE", "WIN"]
    with pytest.raises(ValueError):
        real_only(made.where("symbol = 'EST'"), strict=True)


def test_providers_without_lookup(make_trades):
    made = make_trades(trade())
    for provider in ("synthetic", " None"):
        assert enrich(made, opts=Options(provider=provider, require_real_prices=True)) is made
    (r,) = enrich(made, opts=Options(provider="alpaca")).collect()
    assert (r.option_lookup_status, r.pricing_mode) == ("provider_not_implemented", "synthetic")
    (r,) = enrich(made, opts=Options(provider="Else")).collect()
    assert r.option_lookup_status == "unknown_provider:else"


def test_option_bar_layouts(spark):
    schema = "ticker string, `TS|x` timestamp_ntz, `Close|x` double"
    raw = spark.createDataFrame([("T", dt.datetime(2024, 3, 5, 1, 0), float("nan"))], schema)
    (r,) = read_option_bars_ohlc(raw, ZONE).collect()
    assert r.session_date == DAY and r.close is None
    assert read_option_bars_ohlc(raw.drop("Close|x"), ZONE).count() == 0
    (r,) = quotes(spark, ("T", at(10), 1.5)).withColumn("local", F.col("ts").cast("timestamp_ntz")).collect()
    assert r.local == dt.datetime(2024, 3, 4, 15, 0) and r.close == 1.5


def test_contract_source_filters(spark):
    raw = spark.createDataFrame(
        [contract("2024-03-06", 1), contract("2024-03-19", 2), contract("2024-03-03", 3), contract("2024-03-18", 4, kind="put")],
        CONTRACTS,
    )
    got = read_option_contracts(raw, "X", "call", "2024-03-04").collect()
    assert [r.strike for r in got] == [1.0]
    assert read_option_contracts(raw, contract_type="put").count() == 1
