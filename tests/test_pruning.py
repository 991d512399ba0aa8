"""What reaches the scans of bars and option bars, and what the readers repair."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from test_options import CONTRACTS, TRADES, contract, trade
from wickline.params import Options, Session
from wickline.plans.backtest import indexed_bars
from wickline.plans.enrich import lookup_listed
from wickline.plans.strategy import BandReversal
from wickline.sources.bars import build_bars, read_bars
from wickline.sources.options import read_option_bars_agg, read_option_bars_ohlc, read_option_contracts

ZONE = "America/New_York"
ALL_DAY = Session(start="00:00", end="23:59", timezone=ZONE)


@pytest.fixture(scope="module")
def dated(spark, tmp_path_factory):
    """Bars and option bars, partitioned by date."""
    top = tmp_path_factory.mktemp("dated")
    start = dt.datetime(2024, 3, 4, 15)
    rows = [("AB"[i % 2], start + dt.timedelta(days=i // 4, minutes=i % 4), 1.0 + i) for i in range(80)]
    raw = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")
    bars = raw.selectExpr("*", "close AS open", "close AS high", "close AS low", "1D AS volume", "to_date(ts) AS session_date")
    bars.write.partitionBy("session_date").parquet(str(top / "bars"))
    quotes = raw.selectExpr("concat('O:', symbol) AS ticker", "unix_millis(cast(ts AS timestamp)) AS t", "close AS c", "to_date(ts) AS session_date")
    quotes.write.partitionBy("session_date").parquet(str(top / "quotes"))
    return top


def scans(df):
    """(partition filters, pushed filters) of the partitioned scans."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    return re.findall(r"PartitionFilters: (.*)\n(?:PushedFilters: (.*)\n)?", text)


def test_bars_are_pruned_by_date(spark, dated):
    bars = read_bars(spark, str(dated / "bars"), symbols=["A"], start="2024-03-06", end="2024-03-08", session=ALL_DAY)
    ((partitions, pushed),) = scans(bars)
    assert "2024-03-05" in partitions and "2024-03-09" in partitions and "symbol,A" in pushed
    assert {r.session_date.day for r in bars.collect()} == {6, 7}


@pytest.mark.parametrize("layout", ["agg", "ohlc"])
def test_option_bars_are_pruned_by_ticker_and_date(spark, dated, layout):
    raw = spark.read.parquet(str(dated / "quotes"))
    if layout == "ohlc":
        raw = raw.selectExpr("ticker", "timestamp_millis(t) AS Ts", "c AS `Close`", "session_date")
    read = read_option_bars_agg if layout == "agg" else read_option_bars_ohlc
    quotes = read(raw, ZONE, tickers=["O:A"], start="2024-03-06", end="2024-03-07")
    ((partitions, pushed),) = scans(quotes)
    assert "2024-03-05" in partitions and "2024-03-08" in partitions and "ticker,O:A" in pushed
    assert {(r.ticker, r.session_date.day) for r in quotes.collect()} == {("O:A", 6), ("O:A", 7)}


def test_look_up_prunes_option_bars_at_run_time(spark, dated):
    made = spark.createDataFrame([trade()], TRADES)
    listed = read_option_contracts(spark.createDataFrame([contract("2024-03-06", 101)], CONTRACTS))
    quotes = read_option_bars_agg(spark.read.parquet(str(dated / "quotes")), ZONE)
    found = lookup_listed(made, listed, quotes, Options(), ZONE)
    assert any("dynamicpruning" in partitions for partitions, _ in scans(found))


def test_repeated_bars_are_one(spark, tmp_path):
    at = dt.datetime(2024, 3, 4, 15)
    rows = [("A", at, 1.0, 2.0, 0.5, 1.5, 10.0), ("A", at, 1.1, 2.5, 0.4, 1.4, None), ("B", at, 1.0, 1.0, 1.0, 1.0, 1.0)]
    spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double").write.parquet(str(tmp_path / "b"))
    got = {r.symbol: r for r in read_bars(spark, str(tmp_path / "b")).collect()}
    a = got["A"]
    assert (a.open, a.high, a.low, a.close, a.volume) == (1.0, 2.5, 0.4, 1.5, 10.0)
    assert read_bars(spark, str(tmp_path / "b"), unique=False).count() == 3


def ticks(spark, rows, schema="symbol string, ts timestamp_ntz, price double, size double"):
    return spark.createDataFrame(rows, schema)


def test_the_repeated_hour_has_bars_of_its_own(spark):
    night = [("A", dt.datetime(2024, 11, 3, h, 30), float(h), 1.0) for h in (4, 5, 6, 7)]
    got = sorted(build_bars(ticks(spark, night), "1 hour", ALL_DAY).collect(), key=lambda r: r.ts)
    assert [(r.local_ts.hour, r.open, r.close) for r in got] == [(0, 4.0, 4.0), (1, 5.0, 5.0), (1, 6.0, 6.0), (2, 7.0, 7.0)]
    assert [r.ts.hour for r in got] == [4, 5, 6, 7]
    wide = build_bars(ticks(spark, night), "4 hours", ALL_DAY).collect()
    assert [(r.local_ts.hour, r.open, r.close) for r in wide] == [(0, 4.0, 7.0)]


def test_the_skipped_hour_has_no_bars(spark):
    night = [("A", dt.datetime(2024, 3, 10, h, 30), float(h), 1.0) for h in (5, 6, 7, 8)]
    got = sorted(build_bars(ticks(spark, night), "1 hour", ALL_DAY).collect(), key=lambda r: r.ts)
    assert [(r.local_ts.hour, r.close) for r in got] == [(0, 5.0), (1, 6.0), (3, 7.0), (4, 8.0)]


def test_nan_sizes_leave_no_hole_in_the_ordinals(spark):
    start = dt.datetime(2024, 3, 4, 14, 30)
    rows = []
    for i in range(120):
        size = float("nan") if i == 60 else 5.0
        rows.append(("A", start + dt.timedelta(days=i // 60, minutes=5 * (i % 60)), 100.0 + i % 7, size))
    rows.append(("A", start, float("nan"), 3.0))
    bars = build_bars(ticks(spark, rows), "5 minutes", volume=F.col("size"), order="ts")
    assert bars.where("volume IS NULL").count() == 1 and bars.where("isnan(volume) OR isnan(close)").count() == 0
    for given in (bars, bars.withColumn("volume", F.coalesce("volume", F.lit(float("nan"))))):
        numbers = sorted(r.bar_idx for r in indexed_bars(given, BandReversal()).select("bar_idx").collect())
        assert numbers == list(range(len(numbers))) and numbers
        assert indexed_bars(given, BandReversal()).agg(F.max("bar_idx_total")).first()[0] == len(numbers)
