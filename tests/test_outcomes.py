"""Outcomes of signals: hand cases, a step-by-step check, and properties."""

from __future__ import annotations

import datetime as dt
import random
from dataclasses import dataclass

import pytest
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helpers import clock, flat
from wickline.operators.outcomes import candidate_outcomes, forward_path, non_overlapping
from wickline.params import ReversalParams, Risk
from wickline.plans.backtest import backtest, indexed_bars, price_trades
from wickline.plans.strategy import BandReversal, make_signal

RISK = Risk(option_target_pct=0.2, option_leverage=20.0)  # target 1 %, stop 1 x atr


@dataclass(frozen=True)
class Marked:
    """Signals where the volume says so: 1 long, 2 short; atr is 2."""

    atr: float = 2.0
    name: str = "marked"

    def prepare(self, bars: DataFrame) -> DataFrame:
        return bars.withColumns({"atr": F.lit(self.atr), "ema10": F.col("open"), "ema20": F.col("close")})

    def signal(self) -> Column:
        return F.when(F.col("volume") == 1, make_signal("long", "up")).when(F.col("volume") == 2, make_signal("short", "down"))


def trades(make_bars, rows, risk=RISK, strategy=Marked()):
    got = backtest(make_bars(rows), strategy, risk).collect()
    return sorted(got, key=lambda t: (t.symbol, t.entry_idx))


def path(*bars, day=0, tail=8):
    """A day of bars (high, low, close, volume), then a quiet next day."""
    rows = [("A", clock(day, i), *map(float, (c, h, l, c, v))) for i, (h, l, c, v) in enumerate(bars)]
    return rows + [flat("A", clock(day + 1, i), 100.0, 0.0) for i in range(tail)]


def test_stop_wins_inside_a_bar(make_bars):
    (t,) = trades(make_bars, path((100, 100, 100, 1), (105, 97, 100, 0), (100, 100, 100, 0)))
    assert (t.exit_reason, t.exit_price, t.bars_held, t.hit_target) == ("atr_stop", 98.0, 1, False)
    assert t.r_multiple == pytest.approx(-0.02 * 20 / 0.2)


def test_gap_through_the_stop_exits_at_the_stop(make_bars):
    (t,) = trades(make_bars, path((100, 100, 100, 1), (91, 90, 90, 0), (100, 100, 100, 0)))
    assert (t.exit_reason, t.exit_price) == ("atr_stop", 98.0)


def test_short_levels_are_mirrored(make_bars):
    (t,) = trades(make_bars, path((100, 100, 100, 2), (101, 99.5, 100, 0), (101.5, 98.9, 99, 0)))
    assert (t.exit_reason, t.exit_price, t.bars_held, t.hit_target) == ("profit_target", 99.0, 2, True)
    assert t.option_return_pct == pytest.approx(0.2)
    (t,) = trades(make_bars, path((100, 100, 100, 2), (102, 100, 101, 0), (100, 100, 100, 0)))
    assert (t.exit_reason, t.exit_price) == ("atr_stop", 102.0)


def test_time_exit_is_no_win_even_in_profit(make_bars):
    quiet = (100.5, 100, 100.5, 0)
    (t,) = trades(make_bars, path((100, 100, 100, 1), quiet, quiet, quiet, quiet))
    assert (t.exit_reason, t.exit_price, t.bars_held, t.hit_target) == ("time_exit", 100.5, 3, False)
    assert t.pnl_usd == pytest.approx(100.0)


def test_day_end_after_one_bar(make_bars):
    (t,) = trades(make_bars, path((100, 100, 100, 1), (100.2, 99, 99.5, 0)))
    assert (t.exit_reason, t.exit_price, t.bars_held) == ("day_end_exit", 99.5, 1)


def test_no_trade_into_another_day(make_bars):
    assert trades(make_bars, path((100, 100, 100, 0), (100, 100, 100, 1))) == []


def test_day_end_inside_a_block_and_at_its_end_agree(spark, make_bars):
    rows = path((100, 100, 100, 1), (100.2, 99, 99.5, 0))
    wide = trades(make_bars, rows)
    spark.conf.set("wickline.blockDays", "1")
    try:
        assert trades(make_bars, rows) == wide
    finally:
        spark.conf.unset("wickline.blockDays")


def test_exit_bar_opens_the_next_trade(make_bars):
    rows = path((100, 100, 100, 1), (101, 100, 100, 1), (101, 100, 100, 0), (100, 100, 100, 0))
    first, second = trades(make_bars, rows)
    assert (first.entry_idx, first.exit_idx, second.entry_idx, second.exit_idx) == (0, 1, 1, 2)


def test_last_bars_open_nothing(make_bars):
    rows = [flat("A", clock(0, i), 100.0, 1.0) for i in range(8)]
    assert [t.entry_idx for t in trades(make_bars, rows)] == [0, 3]
    assert trades(make_bars, rows[:4]) == []


def test_degenerate_risk(make_bars):
    rows = path((100, 100, 100, 1), (100, 99, 99.5, 0), (100, 100, 100, 0))
    assert trades(make_bars, rows, Risk(hold_bars=0)) == []
    (t,) = trades(make_bars, rows, Risk(option_leverage=0.0))
    assert (t.exit_reason, t.exit_price, t.option_return_pct) == ("profit_target", 100.0, 0.0)
    (t,) = trades(make_bars, rows, Risk(option_target_pct=0.0, commission_per_trade=3.0))
    assert (t.r_multiple, t.pnl_usd) == (0.0, -3.0)


def test_strategy_without_atr_stops_at_entry(make_bars):
    class NoAtr(Marked):
        def prepare(self, bars):
            return super().prepare(bars).drop("atr")

    (t,) = trades(make_bars, path((100, 100, 100, 1), (100.5, 100, 100.2, 0), (100, 100, 100, 0)), strategy=NoAtr())
    assert (t.exit_reason, t.exit_price, t.trend) == ("atr_stop", 100.0, "Downtrend")


def test_forward_path_crosses_days(make_bars):
    indexed = indexed_bars(make_bars(path((100, 100, 100, 1), (100.2, 99, 99.5, 0))), Marked())
    got = forward_path(indexed.where("volume = 1"), indexed, 3).orderBy("step").collect()
    assert [(r.step, r.step_date.day) for r in got] == [(1, 1), (2, 2), (3, 2)]


def test_greedy_choice_on_intervals(spark):
    rng = random.Random(3)
    rows, want = [], []
    for day in range(30):
        free = -1
        for start in sorted(rng.sample(range(60), 25)):
            end = start + rng.randint(1, 9)
            rows.append(("A", 0, dt.date(2024, 1, 1) + dt.timedelta(days=day), day * 100 + start, day * 100 + end))
            if start >= free:
                want.append(day * 100 + start)
                free = end
    df = spark.createDataFrame(rows, "symbol string, block int, session_date date, entry_idx long, exit_idx long")
    got = non_overlapping(df.repartition(6))
    assert sorted(r.entry_idx for r in got.collect()) == want


def step_by_step(bars: list[dict], risk: Risk) -> list[tuple]:
    """One symbol, one bar after the other."""
    out, position = [], 0
    while position + risk.hold_bars + 1 < len(bars):
        bar = bars[position]
        sign = {"long": 1, "short": -1}.get(bar["side"])
        taken = None
        if sign:
            goal = bar["close"] * (1 + sign * risk.option_target_pct / risk.option_leverage)
            floor = bar["close"] - sign * risk.stop_atr_mult * bar["atr"]
            for ahead in range(1, risk.hold_bars + 1):
                nxt = bars[position + ahead]
                worst, best = (nxt["low"], nxt["high"]) if sign > 0 else (nxt["high"], nxt["low"])
                if nxt["session_date"] != bar["session_date"]:
                    taken = (ahead - 1, bars[position + ahead - 1]["close"], "day_end_exit")
                elif (worst - floor) * sign <= 0:
                    taken = (ahead, floor, "atr_stop")
                elif (best - goal) * sign >= 0:
                    taken = (ahead, goal, "profit_target")
                elif ahead == risk.hold_bars:
                    taken = (ahead, nxt["close"], "time_exit")
                if taken:
                    break
        if taken and taken[0] > 0:
            out.append((bar["bar_idx"], bar["side"], *taken))
            position += taken[0]
        else:
            position += 1
    return out


REVERSAL = BandReversal(
    ReversalParams(bb_length=6, bb_std=1.0, rsi_length=4, volume_ma_length=3, rsi_oversold=50, rsi_overbought=50,
                   min_rel_volume=0.8, min_volume_sma=100.0)
)


@pytest.mark.parametrize("days,hold", [(1, 3), (32, 3), (5, 7)])
def test_backtest_equals_step_by_step(spark, make_bars, random_walk, days, hold):
    risk = Risk(hold_bars=hold, option_target_pct=0.1, stop_atr_mult=0.9)
    bars = make_bars(random_walk("A", 11) + random_walk("B", 12, days=25))
    spark.conf.set("wickline.blockDays", str(days))
    try:
        indexed = indexed_bars(bars, REVERSAL).withColumn("side", REVERSAL.signal().side).orderBy("ts").collect()
        got = backtest(bars.repartition(9), REVERSAL, risk).orderBy("entry_idx").collect()
    finally:
        spark.conf.unset("wickline.blockDays")
    for symbol in ("A", "B"):
        want = step_by_step([r.asDict() for r in indexed if r.symbol == symbol], risk)
        ours = [(t.entry_idx, t.side, t.bars_held, pytest.approx(t.exit_price), t.exit_reason) for t in got if t.symbol == symbol]
        assert len(want) > 10
        assert ours == want
    assert {t.exit_reason for t in got} == {"atr_stop", "profit_target", "time_exit", "day_end_exit"}


def test_trade_properties(make_bars, random_walk):
    rows = random_walk("A", 21) + random_walk("B", 22)
    risk = Risk(option_target_pct=0.1)
    got = trades(make_bars, rows, risk, REVERSAL)
    for symbol in ("A", "B"):
        mine = [t for t in got if t.symbol == symbol]
        assert all(a.exit_idx <= b.entry_idx for a, b in zip(mine, mine[1:]))
        alone = trades(make_bars, [r for r in rows if r[0] == symbol], risk, REVERSAL)
        assert alone == mine
    for t in got:
        assert 1 <= t.bars_held <= 3 and t.exit_idx - t.entry_idx == t.bars_held
        assert t.entry_local.date() == t.exit_local.date() == t.session_date
        assert t.exit_reason != "atr_stop" or t.r_multiple <= 0


def test_result_does_not_depend_on_partitions(spark, make_bars, random_walk):
    rows = random_walk("A", 31) + random_walk("B", 32)
    results = []
    for n in (1, 8, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        results.append(trades(lambda r: make_bars(r).repartition(n), rows, Risk(option_target_pct=0.1), REVERSAL))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]


def test_candidates_hold_overlaps_that_trades_drop(make_bars):
    rows = [flat("A", clock(0, i), 100.0, 1.0) for i in range(12)]
    indexed = indexed_bars(make_bars(rows), Marked())
    candidates = candidate_outcomes(indexed, Marked().signal(), RISK)
    assert candidates.count() == 8
    assert price_trades(non_overlapping(candidates), RISK).count() == 3


def test_twenty_thousand_overlapping_candidates(spark):
    """One day, one run: pointers are doubled, nothing is appended one by one."""
    rng = random.Random(4)
    rows = [("A", 0, dt.date(2024, 3, 4), 3 * i, 3 * i + rng.randint(4, 40)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "symbol string, block int, session_date date, entry_idx bigint, exit_idx bigint")
    free, want = -1, []
    for _, _, _, start, end in rows:
        if start >= free:
            want.append(start)
            free = end
    assert sorted(r.entry_idx for r in non_overlapping(df.repartition(5)).collect()) == want
