"""Trades of several strategies at one bar, and what settling leaves behind."""

from __future__ import annotations

import pytest

from test_options import CHAIN, CONTRACTS, TRADES, at, contract, trade
from wickline.catalog.queries import registered
from wickline.operators.settle import release, settle, settling, shared_folder
from wickline.params import Options
from wickline.plans import report
from wickline.plans.enrich import enrich
from wickline.sources.options import read_option_bars_agg, read_option_chain, read_option_contracts

ZONE = "America/New_York"
QUOTES = "ticker string, t long, c double"


def quotes(spark):
    rows = []
    for ticker, price in (("c06-101", 2.0), ("p06-99", 3.0)):
        for minute in range(0, 60, 15):
            rows.append((ticker, int(at(10, minute).timestamp() * 1000), price + minute / 100))
    return read_option_bars_agg(spark.createDataFrame(rows, QUOTES), ZONE)


def union(spark):
    """A long and a short trade at one bar, a second long one that ends later, and a
    copy of the first: four strategies."""
    rows = [trade(), trade(side="short"), trade(exit_=at(10, 45)), trade()]
    return spark.createDataFrame(rows, TRADES)


@pytest.mark.parametrize("provider", ["polygon", "yahoo"])
def test_every_trade_has_its_own_contract(spark, provider):
    if provider == "polygon":
        rows = [contract("2024-03-06", 101), contract("2024-03-06", 99, kind="put")]
        contracts = read_option_contracts(spark.createDataFrame(rows, CONTRACTS))
    else:
        rows = [("X", "call", "2024-03-06", 101.0, "c06-101"), ("X", "put", "2024-03-06", 99.0, "p06-99")]
        contracts = read_option_chain(spark.createDataFrame(rows, CHAIN))
    opts = Options(provider=provider, use_real_prices_for_pnl=True)
    with settling(spark):
        got = enrich(union(spark), contracts, quotes(spark), opts, timezone=ZONE).collect()
    found = sorted((r.side, r.option_contract, r.option_entry_price, r.option_exit_price, r.option_lookup_status) for r in got)
    assert found == [
        ("long", "c06-101", 2.0, 2.15, "ok"),
        ("long", "c06-101", 2.0, 2.15, "ok"),
        ("long", "c06-101", 2.0, 2.45, "ok"),
        ("short", "p06-99", 3.0, 3.15, "ok"),
    ]


def test_numbers_of_tied_trades_dont_depend_on_partitions(spark):
    logs = []
    for parts in (1, 4):
        log = report.trade_log(union(spark).repartition(parts)).collect()
        logs.append(sorted((r.trade_id, r.side, r.exit_time) for r in log))
    assert logs[0] == logs[1] and [n for n, *_ in logs[0]] == [1, 2, 3, 4]


def settled_files(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def test_a_query_leaves_nothing_behind(spark):
    release(spark)
    before = settled_files(spark)
    with settling(spark):
        assert registered()["lookup_status_agg"](spark, "/root/testdata/sf0.001").count() > 0
        assert len(settled_files(spark)) > len(before)
    assert settled_files(spark) == before
    kept = settle(spark.range(3))
    with settling(spark):
        settle(spark.range(4))
    assert kept.count() == 3
    release(spark)
    assert settled_files(spark) == before
