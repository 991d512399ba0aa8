"""Shape of the physical plans: what must and must not be in them."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from helpers import flat
from test_options import CHAIN, CONTRACTS, TRADES, contract, trade
from wickline.operators import contracts as C
from wickline.operators.asof import asof_prices
from wickline.operators.blocks import with_block, with_history
from wickline.operators.outcomes import forward_path
from wickline.params import Options, Risk
from wickline.plans import report
from wickline.plans.backtest import backtest, indexed_bars
from wickline.plans.enrich import lookup_chain, lookup_listed
from wickline.plans.strategy import BandReversal
from wickline.sources.bars import build_bars, read_bars
from wickline.sources.options import listed_on, read_contract_intervals, read_option_bars_agg, read_option_chain, read_option_contracts

ZONE = "America/New_York"
QUADRATIC = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture(scope="module")
def stored_bars(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bars") / "bars")
    start = dt.datetime(2024, 3, 4, 14, 30)
    rows = [("AB"[i % 2], start + dt.timedelta(days=i // 40, minutes=i % 40), 1.0 + i % 7) for i in range(400)]
    raw = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")
    raw.selectExpr("*", "close as open", "close as high", "close as low", "100D as volume", "'x' as note").write.parquet(path)
    return read_bars(spark, path)


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def executed(df):
    df.collect()
    text = planned(df)
    return text[: text.index("== Initial Plan ==")] if "== Initial Plan ==" in text else text


def windows(plan):
    """Partition columns of every window, without expression ids."""
    found = re.findall(r"Window \[.*?\], \[([^\[\]]*)\], \[", plan)
    return [re.sub(r"#\d+L?", "", w) for w in found]


def test_backtest_shuffles_bars_once(stored_bars):
    made = backtest(stored_bars, BandReversal(), Risk())
    plan = executed(made)
    assert not any(q in plan for q in QUADRATIC)
    # The bars with their history, and the few newest rows of each block; the second
    # pass of the scan reads the first of these again. All else that moves by block are
    # side tables of a row per block.
    assert len([c for c in exchanged(made, "symbol, block") if "close" in c]) == 2
    assert "ReusedExchange" in plan
    assert "Python" not in plan
    assert "WindowGroupLimit" in planned(with_history(with_block(stored_bars), 19))


def exchanged(df, keys):
    """The columns of each exchange by ``keys`` in the plan that has run."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    text = re.sub(r"#\d+L?", "", text)
    tree = text.split("Initial Plan")[0].split("\n\n(")[0]
    nodes = set(re.findall(r"\((\d+)\)", tree))
    found = re.findall(r"\n\((\d+)\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: hashpartitioning\(" + keys + r", \d+\)", text)
    return [columns.split(", ") for n, columns in found if n in nodes]


def test_no_bar_is_partitioned_by_symbol_alone(stored_bars):
    made = backtest(stored_bars, BandReversal(), Risk())
    made.collect()
    alone = exchanged(made, "symbol")
    assert alone and not any("close" in columns or "ts" in columns for columns in alone)


def test_only_days_with_signals_are_gathered(stored_bars):
    plan = planned(backtest(stored_bars, BandReversal(), Risk(hold_bars=390)))
    gathered = [line for line in plan.splitlines() if "collect_list(" in line and "low" in line]
    assert gathered and all("session_date" in line for line in gathered)
    assert re.search(r"Filter [^\n]*day_opens", plan)


def test_scan_reads_only_bar_columns(stored_bars):
    plan = planned(indexed_bars(stored_bars, BandReversal()))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("note" not in s for s in schemas)


def test_ticks_are_combined_before_the_shuffle(spark):
    ticks = spark.createDataFrame([("A", dt.datetime(2024, 3, 4, 15), 1.0)], "symbol string, ts timestamp_ntz, price double")
    plan = planned(build_bars(ticks, "5 minutes"))
    assert plan.count("Exchange") == 1 and "partial_max_by" in plan


def test_lookups_form_no_pairs(spark):
    made = spark.createDataFrame([trade()], TRADES)
    listed = read_option_contracts(spark.createDataFrame([contract("2024-03-06", 101)], CONTRACTS))
    chain = read_option_chain(spark.createDataFrame([("X", "call", "2024-03-06", 101.0, "a")], CHAIN))
    quotes = read_option_bars_agg(spark.createDataFrame([("a", 0, 1.0)], "ticker string, t long, c double"), ZONE)
    for found in (
        lookup_listed(made, listed, quotes, Options(), ZONE),
        lookup_chain(made, chain, quotes, Options(), ZONE),
        C.pick_contract(C.with_request(made, 2, ZONE), listed, 1),
    ):
        plan = planned(found)
        assert not any(q in plan for q in QUADRATIC)
        # Contracts and requests are sorted together: no join on the strike, and the
        # spot is only compared for equality, as a part of a look-up's key.
        assert not re.search(r"Join .*strike#", plan)
        assert not re.search(r"Join .*(spot#\d+ [<>]|[<>]=? spot#)", plan)
    lookups = made.selectExpr("symbol", "entry_time", "exit_time", "'a' as ticker", "session_date as first_date", "session_date as last_date")
    plan = planned(asof_prices(lookups, quotes))
    assert "ticker, session_date" in windows(plan)
    assert not any(q in plan for q in QUADRATIC)


def test_intervals_are_met_by_buckets(spark):
    spans = spark.createDataFrame([("X", "call", "2024-01-01", None, "2024-03-08", "101", "a")], "underlying string, contract_type string, listed_from string, listed_to string, expiration_date string, strike_price string, ticker string")
    requests = C.with_request(spark.createDataFrame([trade()], TRADES), 2, ZONE)
    found = listed_on(read_contract_intervals(spans), requests)
    assert not any(q in planned(found) for q in QUADRATIC) and "bucket" in planned(found)


def test_reports_stay_distributed(spark, stored_bars):
    made = spark.createDataFrame([trade()], TRADES)
    assert "WindowGroupLimit" in planned(report.example_trades(made, 2))
    indexed = indexed_bars(stored_bars, BandReversal())
    examples = made.withColumn("example", F.lit(1))
    for df in (report.trade_context(examples, indexed), forward_path(indexed.limit(3), indexed, 3), report.trade_log(made)):
        assert not any(q in planned(df) for q in QUADRATIC)


def test_flat_series_has_no_signal(make_bars):
    bars = make_bars([flat("A", dt.datetime(2024, 3, 4, 9, 30) + dt.timedelta(minutes=i), 50.0) for i in range(60)])
    assert backtest(bars, BandReversal(), Risk()).count() == 0
