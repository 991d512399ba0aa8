"""Indicators over blocks against pandas over the whole series."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from helpers import clock, flat
from wickline.operators import indicators as I
from wickline.operators import scan
from wickline.operators.blocks import with_block, with_history, with_ordinal
from wickline.params import ReversalParams
from wickline.plans.backtest import indexed_bars
from wickline.plans.strategy import BandReversal

PARAMS = ReversalParams(bb_length=7, rsi_length=5, atr_length=6, volume_ma_length=4)


@pytest.fixture(params=[(1, 4096), (2, 5), (32, 3), (32, 4096)], ids=str)
def blocking(request, spark, monkeypatch):
    """Block length in days and rows per segment of the scan."""
    days, segment = request.param
    spark.conf.set("wickline.blockDays", str(days))
    monkeypatch.setattr(scan, "MAX_SEGMENT", segment)
    yield
    spark.conf.unset("wickline.blockDays")


def frame(df, *columns):
    pdf = df.select("symbol", "local_ts", *columns).toPandas()
    return {s: g.sort_values("local_ts").reset_index(drop=True) for s, g in pdf.groupby("symbol")}


def series(rows):
    cols = ["symbol", "local_ts", "open", "high", "low", "close", "volume"]
    return {s: g.reset_index(drop=True) for s, g in pd.DataFrame(rows, columns=cols).groupby("symbol")}


def close_to(ours, theirs):
    np.testing.assert_allclose(ours.astype(float), theirs.astype(float), rtol=1e-11, atol=1e-9, equal_nan=True)


def expected(g, p):
    out = pd.DataFrame({"bb_basis": g.close.rolling(p.bb_length).mean()})
    sigma = g.close.rolling(p.bb_length).std(ddof=0)
    out["bb_upper"], out["bb_lower"] = out.bb_basis + p.bb_std * sigma, out.bb_basis - p.bb_std * sigma
    change = g.close.diff()
    up = change.where(change > 0, 0.0).where(change.notna()).ewm(alpha=1 / p.rsi_length, adjust=False).mean()
    down = (-change).where(change < 0, 0.0).where(change.notna()).ewm(alpha=1 / p.rsi_length, adjust=False).mean()
    out["rsi"] = (100 * up / (up + down)).where(down > 0, 50.0).fillna(50.0)
    before = g.close.shift()
    reach = np.fmax(g.high, before.fillna(g.high)) - np.fmin(g.low, before.fillna(g.low))
    out["atr"] = reach.ewm(alpha=1 / p.atr_length, adjust=False).mean()
    out["volume_sma"] = g.volume.rolling(p.volume_ma_length).mean()
    out["rel_volume"] = g.volume / out.volume_sma
    out["ema10"], out["ema20"] = g.close.ewm(span=10, adjust=False).mean(), g.close.ewm(span=20, adjust=False).mean()
    return out


def test_prepared_matches_pandas(blocking, make_bars, random_walk):
    rows = random_walk("A", 1) + random_walk("B", 2, days=3) + random_walk("C", 3, per_day=2)
    columns = ["bb_basis", "bb_upper", "bb_lower", "rsi", "atr", "volume_sma", "rel_volume", "ema10", "ema20"]
    ours = frame(BandReversal(PARAMS).prepare(make_bars(rows).repartition(5)), *columns, "bar_idx", "bar_idx_total")
    for symbol, g in series(rows).items():
        want = expected(g, PARAMS)
        for c in columns:
            close_to(ours[symbol][c], want[c])
        complete = want.notna().all(axis=1)
        assert ours[symbol].bar_idx[complete].tolist() == list(range(complete.sum()))
        assert ours[symbol].bar_idx[~complete].isna().all()
        assert set(ours[symbol].bar_idx_total) == {complete.sum()}


def test_single_indicators_agree_with_prepared(blocking, make_bars, random_walk):
    rows = random_walk("A", 5, days=12)
    bars = make_bars(rows)
    g = series(rows)["A"]
    want = expected(g, PARAMS)
    close_to(frame(I.bollinger(bars, 7), "bb_upper")["A"].bb_upper, want.bb_upper)
    close_to(frame(I.rsi(bars, 5), "rsi")["A"].rsi, want.rsi)
    close_to(frame(I.atr(bars, 6), "atr")["A"].atr, want.atr)
    close_to(frame(I.ema(bars, {"e": 10}), "e")["A"].e, want.ema10)
    close_to(frame(I.relative_volume(bars, 4), "rel_volume")["A"].rel_volume, want.rel_volume)


def test_constant_close_is_flat_everywhere(blocking, make_bars):
    bars = make_bars([flat("A", clock(d, b), 301.7) for d in range(6) for b in range(9)])
    got = frame(BandReversal(PARAMS).prepare(bars), "close", "rsi", "bb_upper", "bb_lower", "ema10", "ema20")["A"]
    assert set(got.rsi) == {50.0}
    assert (got.ema10 == got.close).all() and (got.ema20 == got.close).all()
    np.testing.assert_allclose(got.bb_upper.dropna(), 301.7)
    np.testing.assert_allclose(got.bb_lower.dropna(), 301.7)


def test_rising_close_reads_fifty_until_the_first_loss(blocking, make_bars):
    closes = [100.0 + i for i in range(30)] + [120.0]
    bars = make_bars([flat("A", clock(i // 6, i % 6), c) for i, c in enumerate(closes)])
    got = frame(I.rsi(bars, 5), "rsi")["A"].rsi
    assert set(got[:30]) == {50.0}
    assert got[30] < 50


def test_loss_long_ago_still_counts(make_bars):
    """A loss average that has decayed far below rounding is not zero."""
    closes = [100.0, 99.0] + [99.0] * 1500 + [100.0]
    bars = make_bars([flat("A", clock(i // 40, i % 40), c) for i, c in enumerate(closes)])
    got = frame(I.rsi(bars, 14), "rsi")["A"].rsi
    assert got.iloc[-2] < 50
    assert got.iloc[-1] == pytest.approx(100.0)


def test_long_series_does_not_overflow(make_bars):
    rng = np.random.default_rng(7)
    closes = 100 + np.round(rng.normal(0, 1, 6000).cumsum() * 0.1, 4)
    rows = [flat("A", clock(i // 1400, i % 1400, minutes=1), float(c)) for i, c in enumerate(closes)]
    got = frame(I.ewm(make_bars(rows), {"m": ("close", 0.6), "n": ("close", 1.0)}), "m", "n")["A"]
    close_to(got.m, pd.Series(closes).ewm(alpha=0.6, adjust=False).mean())
    assert (got.n.to_numpy() == closes).all()


def test_true_range_of_a_first_bar_is_its_own_range(make_bars):
    got = frame(I.atr(make_bars([("A", clock(0, 0), 10.0, 12.0, 9.0, 11.0, 1.0)])), "tr", "atr")["A"]
    assert got.tr[0] == 3.0 and got.atr[0] == pytest.approx(3.0)


def test_null_volume_removes_its_window_and_renumbers(make_bars):
    rows = [flat("A", clock(i // 20, i % 20), 100.0 + i % 3, None if i == 30 else 10.0) for i in range(80)]
    got = frame(indexed_bars(make_bars(rows), BandReversal()), "bar_idx")["A"]
    assert got.bar_idx.tolist() == list(range(80 - 19 - 20))


def test_zero_volume_stretch_has_no_relative_volume(make_bars):
    rows = [flat("A", clock(i // 20, i % 20), 100.0, 0.0 if i < 40 else 5.0) for i in range(60)]
    got = frame(indexed_bars(make_bars(rows), BandReversal()), "rel_volume")["A"]
    assert len(got) == 20 and got.rel_volume.notna().all()


@pytest.mark.parametrize("rows_back", [1, 3, 10])
def test_history_bridges_sparse_blocks(spark, make_bars, rows_back):
    spark.conf.set("wickline.blockDays", "1")
    try:
        rows = [flat("A", clock(d * 2, b), 100.0 + d) for d in range(12) for b in range(1 + d % 3)]
        framed = with_history(with_block(make_bars(rows)), rows_back).toPandas()
    finally:
        spark.conf.unset("wickline.blockDays")
    times = sorted(r[1] for r in rows)
    for _, g in framed.groupby("block"):
        first = g[~g.is_history].local_ts.min()
        want = [t for t in times if t < first][-rows_back:]
        assert sorted(t.to_pydatetime() for t in g[g.is_history].local_ts) == want


def test_ordinals_over_blocks(spark, make_bars, random_walk):
    bars = with_block(make_bars(random_walk("A", 1) + random_walk("B", 2, days=9)), days=3).repartition(7)
    got = with_ordinal(bars, "n", ["ts"], total="all").toPandas()
    for _, g in got.groupby("symbol"):
        assert g.sort_values("ts").n.tolist() == list(range(len(g)))
        assert set(g["all"]) == {len(g)}


def test_holes_match_pandas(blocking, make_bars):
    """Missing values at the begin, inside and at the end of segments and blocks."""
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for symbol, missing in (("A", 0.3), ("B", 0.9), ("C", 0.0), ("D", 1.0)):
        values = [None if rng.random() < missing else round(float(rng.normal(100, 5)), 3) for _ in range(150)]
        if symbol == "A":
            values[:7] = [None] * 7
            values[40:75] = [None] * 35
        rows += [(symbol, clock(i // 6, i % 6), 1.0, 1.0, 1.0, 1.0, v) for i, v in enumerate(values)]
        want[symbol] = pd.Series(values, dtype=float)
    averages = {"slow": ("volume", 1 / 14), "fast": ("volume", 0.7), "same": ("volume", 1.0), "level": ("volume", 0.2)}
    got = frame(I.ewm(make_bars(rows).repartition(4), averages, levels=("level",)), *averages)
    for symbol, s in want.items():
        for name, (_, alpha) in averages.items():
            close_to(got[symbol][name], s.ewm(alpha=alpha, adjust=False).mean())


def test_flat_series_with_holes_stays_flat(blocking, make_bars):
    rows = [("A", clock(i // 7, i % 7), 1.0, 1.0, 1.0, 1.0, None if i % 3 else 301.7) for i in range(90)]
    got = frame(I.ewm(make_bars(rows), {"m": ("volume", 0.15)}, levels=("m",)), "m")["A"].m
    assert set(got) == {301.7}


def test_symbol_of_five_thousand_blocks(spark, make_bars):
    """Three levels: blocks of a day, super-blocks, the symbol."""
    rng = np.random.default_rng(5)
    closes = 100 + np.round(rng.normal(0, 1, 5000).cumsum() * 0.1, 3)
    start = clock(0, 0, month=1)
    rows = [flat("A", start + pd.Timedelta(days=i), float(c)) for i, c in enumerate(closes)]
    spark.conf.set("wickline.blockDays", "1")
    try:
        got = frame(I.ema(make_bars(rows), {"e": 30}), "e")["A"].e
        bands = frame(I.rolling(make_bars(rows), "close", 30), "rolling_mean")["A"].rolling_mean
    finally:
        spark.conf.unset("wickline.blockDays")
    close_to(got, pd.Series(closes).ewm(span=30, adjust=False).mean())
    close_to(bands, pd.Series(closes).rolling(30).mean())


@pytest.mark.parametrize("length, days", [(65, 1), (130, 32), (2000, 32), (2000, 7)])
def test_wide_frames_match_pandas(spark, make_bars, length, days):
    rng = np.random.default_rng(length)
    closes = 1e6 + np.round(rng.normal(0, 1, 4600).cumsum(), 3)
    rows = [("A", clock(i // 300, i % 300, minutes=1), *[float(c)] * 4, None if i == 2500 else float(i % 50)) for i, c in enumerate(closes)]
    rows += [flat("B", clock(i // 300, i % 300, minutes=1), 301.7) for i in range(2100)]
    spark.conf.set("wickline.blockDays", str(days))
    try:
        bars = make_bars(rows)
        got = frame(I.rolling(bars, "close", length), "rolling_mean", "rolling_std")
        volume = frame(I.rolling(bars, "volume", length), "rolling_mean")["A"].rolling_mean
    finally:
        spark.conf.unset("wickline.blockDays")
    want = pd.Series(closes - 1e6).rolling(length)
    close_to(got["A"].rolling_mean - 1e6, want.mean())
    np.testing.assert_allclose(got["A"].rolling_std, want.std(ddof=0), rtol=1e-7)
    assert set(got["B"].rolling_std.dropna()) == {0.0} and set(got["B"].rolling_mean.dropna()) == {301.7}
    close_to(volume, pd.Series([r[6] for r in rows if r[0] == "A"], dtype=float).rolling(length).mean())


def test_days_of_blocks_dont_matter(spark, make_bars, random_walk):
    """Routing by counts: blocks of one day and of 32 days give the same frames."""
    bars = make_bars(random_walk("A", 3) + random_walk("B", 4, per_day=2))
    seen = []
    for days in ("1", "32"):
        spark.conf.set("wickline.blockDays", days)
        try:
            seen.append(I.bollinger(bars, 9).orderBy("symbol", "ts").toPandas())
        finally:
            spark.conf.unset("wickline.blockDays")
    pd.testing.assert_frame_equal(*seen)
