"""Bar sources, sinks, reports."""

from __future__ import annotations

import csv
import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from helpers import clock, flat
from test_options import TRADES, at, trade
from wickline.functions.text import thousands, two_decimals
from wickline.operators.blocks import running_total
from wickline.params import Session
from wickline.plans import report
from wickline.plans.backtest import indexed_bars
from wickline.plans.strategy import BandReversal
from wickline.sources.bars import build_bars, localize, normalize_columns, read_bars, session_bars, session_filter

NY = "America/New_York"


def test_normalize_lowers_names_and_reports_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0, float("nan"), 4.0, None)], "`Open|SPY` double, HIGH double, low double, Close double, volume double")
    (r,) = normalize_columns(df).collect()
    assert (r.open, r.high, r.low, r.close, r.volume) == (1.0, 2.0, None, 4.0, None)
    with pytest.raises(ValueError, match=r"\['close', 'volume'\]"):
        normalize_columns(df.select("`Open|SPY`", "HIGH", "low"))


def test_localize_follows_the_clock_change(spark):
    raw = spark.createDataFrame([(dt.datetime(2024, 3, 8, 14, 30),), (dt.datetime(2024, 3, 11, 13, 30),)], "ts timestamp_ntz")
    got = localize(raw, NY)
    assert {r.local_ts.time() for r in got.collect()} == {dt.time(9, 30)}
    assert dict(got.dtypes)["ts"] == "timestamp"


def test_localize_wants_utc_sessions(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        with pytest.raises(ValueError, match="must be UTC"):
            localize(spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "ts timestamp_ntz"), NY)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(
    "start,end,want",
    [("09:30", "16:00", [9, 12, 15]), ("20:00", "08:00", [0, 7, 20, 23]), ("08:00", "08:00", []), ("16:00", "20:00", [16, 19])],
)
def test_session_is_half_open_and_wraps(spark, start, end, want):
    hours = [0, 7, 8, 9, 12, 15, 16, 19, 20, 23]
    rows = [(dt.datetime(2024, 1, 2, h, 30 if h == 9 else 0),) for h in hours]
    got = session_filter(spark.createDataFrame(rows, "local_ts timestamp_ntz"), start, end)
    assert sorted(r.local_ts.hour for r in got.collect()) == want


def test_read_bars_prunes_and_filters(spark, tmp_path):
    rows = [
        ("A", dt.datetime(2024, 3, 4, 14, 30), 1.0, 2.0, 0.5, 1.5, None, "x"),
        ("A", dt.datetime(2024, 3, 4, 15, 0), 1.0, 2.0, None, 1.5, 5.0, "x"),
        ("A", dt.datetime(2024, 3, 5, 15, 0), 1.0, 2.0, 0.5, 1.5, 5.0, "x"),
        ("B", dt.datetime(2024, 3, 4, 15, 0), 1.0, 2.0, 0.5, 1.5, 5.0, "x"),
        ("A", dt.datetime(2024, 3, 4, 22, 0), 1.0, 2.0, 0.5, 1.5, 5.0, "x"),
    ]
    schema = "symbol string, Ts timestamp_ntz, Open double, High double, Low double, Close double, Volume double, Extra string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "bars"))
    got = read_bars(spark, str(tmp_path / "bars"), symbols=["A"], start="2024-03-04", end="2024-03-05")
    (r,) = got.collect()
    assert r.volume is None and r.local_ts == dt.datetime(2024, 3, 4, 9, 30) and r.session_date == dt.date(2024, 3, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "EqualTo(symbol,A)" in pushed and "GreaterThanOrEqual(Ts" in pushed
    assert "Extra" not in plan[plan.index("ReadSchema") :]
    with pytest.raises(ValueError, match="no bars"):
        read_bars(spark, str(tmp_path / "bars"), symbols=["C"], strict=True)


def test_read_bars_csv(spark, tmp_path):
    (tmp_path / "b.csv").write_text("symbol,ts,open,high,low,close,volume\nA,2024-03-04T15:00:00Z,1,2,0.5,1.5,\n")
    schema = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
    (r,) = read_bars(spark, str(tmp_path), fmt="csv", schema=schema).collect()
    assert r.local_ts.hour == 10 and r.volume is None


def test_bars_from_ticks(spark):
    rows = [("A", dt.datetime(2024, 3, 4, 15, 0, s), i, p, 10.0) for i, (s, p) in enumerate([(1, 5.0), (1, 7.0), (30, 4.0), (59, 6.0)])]
    rows.append(("A", dt.datetime(2024, 3, 4, 15, 7), 9, 8.0, 10.0))
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, n int, price double, size double")
    first, second = build_bars(ticks, "5 minutes", order="n", volume=F.col("size")).orderBy("ts").collect()
    assert (first.open, first.high, first.low, first.close, first.volume) == (5.0, 7.0, 4.0, 6.0, 40.0)
    assert first.local_ts == dt.datetime(2024, 3, 4, 10, 0) and second.local_ts == dt.datetime(2024, 3, 4, 10, 5)
    assert build_bars(ticks, "5 minutes", order="n").selectExpr("cast(min(ts) as timestamp_ntz) as t").first().t.hour == 15


def test_running_total_does_not_depend_on_buckets(spark):
    rows = [("A" if i % 3 else "B", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=(i * 37) % 4000), i, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, tie int, v long")
    want = {}
    for key in "AB":
        total = 0
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            total += r[3]
            want[r[2]] = total
    for width in (1, 60, 100_000):
        got = running_total(df.repartition(5), "total", F.col("v"), "k", "ts", "tie", width)
        assert {r.tie: r.total for r in got.collect()} == want


def test_extra_columns_do_not_take_part(spark, make_bars):
    bars = make_bars([flat("A", clock(0, i), 100.0 + i % 2) for i in range(30)]).withColumn("note", F.lit(None).cast("string"))
    again = session_bars(bars.drop("local_ts", "session_date"), Session())
    assert "note" not in again.columns and indexed_bars(again, BandReversal()).count() == 11


def test_summary_of_nothing(spark):
    none = spark.createDataFrame([], TRADES)
    (r,) = report.summary(none).collect()
    assert (r.total, r.wins, r.losses, r.net_pnl, r.total_r, r.avg_r, r.win_rate, r.setups, r.incomplete) == (0, 0, 0, 0, 0, 0, 0, 0, 0)
    up, down = report.summary_by_trend(none).orderBy("trend_order").collect()
    assert (up.trend, up.total, up.win_rate) == ("Uptrend", 0, 0.0) and (down.trend, down.avg_r) == ("Downtrend", 0.0)


def test_trends_add_up_to_the_summary(spark):
    rows = [trade(idx=i, entry=at(10, i)) for i in range(5)]
    made = spark.createDataFrame(rows, TRADES).withColumn("trend", F.when(F.col("entry_idx") < 2, "Uptrend").otherwise("Downtrend"))
    made = made.withColumn("hit_target", F.col("entry_idx") == 1)
    (total,) = report.summary(made).collect()
    up, down = report.summary_by_trend(made).orderBy("trend_order").collect()
    assert (total.total, total.wins, total.losses) == (5, 1, 4) == (up.total + down.total, up.wins + down.wins, up.losses + down.losses)
    assert total.net_pnl == up.net_pnl + down.net_pnl and up.win_rate == 0.5 and total.win_rate == 0.2


LOG = (
    "trade_id,entry_time,exit_time,side,option_contract,option_entry_price,option_exit_price,underlying_entry_price,"
    "underlying_exit_price,bars_held,signal_reason,exit_reason,hit_target,option_return_pct,pnl_usd,r_multiple,trend,"
    "pricing_mode,option_lookup_status"
).split(",")


def test_trade_log_files(spark, tmp_path):
    rows = [trade(s, entry=at(10 + i, day=4 + i), idx=i, side="short" if i % 2 else "long") for s in ("B", "A") for i in range(4)]
    made = spark.createDataFrame(rows, TRADES).repartition(4)
    report.write_trade_log(made, str(tmp_path / "all"), overall=True)
    lines = [line for f in sorted(glob.glob(str(tmp_path / "all/*.csv"))) for line in list(csv.reader(open(f)))]
    assert lines[0] == LOG
    body = [line for line in lines if line != LOG]
    assert [int(line[0]) for line in body] == list(range(1, 9))
    assert [line[4] for line in body[:4]] == ["A-SIM-C", "B-SIM-C", "A-SIM-P", "B-SIM-P"]
    assert (body[0][1], body[0][2]) == ("2024-03-04 10:00:00-05:00", "2024-03-04 10:15:00-05:00")
    report.write_trade_log(made, str(tmp_path / "each"))
    for symbol in "AB":
        files = sorted(glob.glob(str(tmp_path / f"each/symbol={symbol}/*.csv")))
        body = [line for f in files for line in list(csv.reader(open(f)))[1:]]
        assert [int(line[0]) for line in body] == [1, 2, 3, 4]


def test_display_log(spark):
    made = spark.createDataFrame([trade(spot=312.435, real=(None, 1.005)), trade(idx=1, entry=at(11), side="short", spot=0.125)], TRADES)
    one, two = report.display_log(made).orderBy("number").collect()
    assert (one.number, one.entry_time, one.exit_time) == (1, "2024-03-04 10:00", "2024-03-04 10:15")
    assert (one.spot_in, one.option, one.option_in, one.option_out) == (f"{312.435:.2f}", "-", "-", f"{1.005:.2f}")
    assert (one.option_return, one.pnl, one.r) == ("1.00%", "10.00", "0.20")
    assert (two.side, two.spot_in) == ("short", "0.12")


def test_two_decimals_like_printf(spark):
    import random

    rng = random.Random(1)
    values = [0.0, -0.0, 0.005, 1.005, 2.675, 0.125, 0.375, -0.125, -2.5, 99.995, 99.999, 1e6 + 0.005, 312.435, -0.001]
    values += [round(rng.uniform(-500, 500), 3) for _ in range(2000)] + [rng.uniform(-2, 2) for _ in range(500)]
    values += [1e15 + 0.37, 2.0**53, 1e19, -1e22, 0.995, 9.995, 999.995]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", two_decimals(F.col("v")).alias("s"), thousands(F.col("v")).alias("t")).collect()
    assert [(r.v, r.s) for r in got if r.s != f"{r.v:.2f}"] == []
    assert [(r.v, r.t) for r in got if r.t != f"{r.v:,.2f}"] == []


def test_display_summary(spark):
    made = spark.createDataFrame([trade(idx=i, entry=at(10, i)) for i in range(3)], TRADES).withColumn("pnl_usd", F.lit(-411_522.005))
    (r,) = report.display_summary(made).collect()
    assert (r.total, r.net_pnl, r.win_rate) == ("3", f"${3 * -411_522.005:,.2f}", "0.00%")


@pytest.mark.parametrize(
    "wins,count,want",
    [("LLWLW", 2, [2, 0]), ("LLWLW", 3, [2, 0, 1]), ("LLWLW", 9, [2, 0, 1, 3, 4]), ("WWW", 2, [0, 1]), ("LL", 1, [0]), ("LW", 1, [1]), ("W", 0, [])],
)
def test_example_trades(spark, wins, count, want):
    rows = [trade(idx=i, entry=at(10, i)) for i in range(len(wins))]
    hits = [i for i, w in enumerate(wins) if w == "W"]
    made = spark.createDataFrame(rows, TRADES).withColumn("hit_target", F.col("entry_idx").isin(hits))
    assert [r.entry_idx for r in report.example_trades(made, count).orderBy("example").collect()] == want


def test_context_is_clipped_and_marked(spark, make_bars):
    bars = make_bars([flat("A", clock(i // 30, i % 30), 100.0 + i % 5) for i in range(90)])
    indexed = indexed_bars(bars, BandReversal())
    examples = spark.createDataFrame([trade("A", idx=5), trade("A", idx=60)], TRADES).withColumn("example", F.col("entry_idx"))
    got = report.trade_context(examples, indexed).collect()
    early = sorted((r for r in got if r.example == 5), key=lambda r: r.position)
    late = sorted((r for r in got if r.example == 60), key=lambda r: r.position)
    assert [r.position for r in early] == list(range(0, 29)) and [r.position for r in early if r.is_entry] == [5]
    assert [r.position for r in early if r.is_exit] == [8]
    assert [r.position for r in late] == list(range(0, 31)) and [r.position for r in late if r.is_entry] == [20]
