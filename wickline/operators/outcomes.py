"""Outcome of every signal, and the choice of non-overlapping trades."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickline.functions import pricing as P
from wickline.params import Risk

DAY = ("symbol", "block", "session_date")

# Exit reasons.
DAY_END, STOP, TARGET, TIME = "day_end_exit", "atr_stop", "profit_target", "time_exit"


def eligible(hold_bars: int) -> Column:
    """A bar may open a trade only if ``hold_bars + 1`` more bars follow it."""
    return F.col("bar_idx") < F.col("bar_idx_total") - F.lit(hold_bars + 1)


def forward_path(signals: DataFrame, indexed: DataFrame, hold_bars: int) -> DataFrame:
    """The next ``hold_bars`` bars of each signal, one row per step, over day
    boundaries. An equi-join on (symbol, bar_idx), so any horizon spreads."""
    steps = signals.select(
        "symbol",
        F.col("bar_idx").alias("entry_idx"),
        F.posexplode(F.sequence(F.col("bar_idx") + 1, F.col("bar_idx") + hold_bars)).alias("pos", "bar_idx"),
    )
    bars = indexed.select(
        "symbol",
        "bar_idx",
        F.col("local_ts").alias("step_time"),
        F.col("session_date").alias("step_date"),
        *[F.col(c).alias(f"step_{c}") for c in ("high", "low", "close")],
    )
    return steps.join(bars, ["symbol", "bar_idx"]).select(
        "symbol", "entry_idx", (F.col("pos") + 1).alias("step"), "step_time", "step_date", "step_high", "step_low", "step_close"
    )


def candidate_outcomes(indexed: DataFrame, signal: Column, risk: Risk) -> DataFrame:
    """One row per eligible signal that lasts at least one bar, with its exit.

    A trade never leaves its day and a day never leaves its block, so a day is searched
    on its own: a row of its bars, and over their lows and highs a sparse table. Level
    ``j`` holds the least low and the highest high of the ``2^j`` bars from each place
    on, and a signal skips in powers of two what touches neither of its barriers. So it
    finds its first stop or target in O(log hold_bars), and a day costs O(n log
    hold_bars) for all its signals. Days without a signal are left out before any bar is
    gathered; a day's row is bounded by its bars.
    """
    atr = F.col("atr") if "atr" in indexed.columns else F.lit(0.0)
    side, entry = F.col("signal.side"), F.col("close")
    opens = F.col("signal").isNotNull() & eligible(risk.hold_bars)
    judged = indexed.withColumn("signal", signal).withColumn("opens", opens)
    traded = judged.withColumn("day_opens", F.max("opens").over(Window.partitionBy(*DAY))).where("day_opens")
    plan = F.struct(
        side.alias("side"),
        F.col("signal.reason").alias("reason"),
        P.trend_label(F.col("ema10"), F.col("ema20")).alias("trend"),
        P.target_price(side, entry, risk).alias("target"),
        P.stop_price(side, entry, atr, risk).alias("stop"),
    )
    bar = F.struct("ts", "local_ts", "high", "low", "close", "bar_idx", F.when(F.col("opens"), plan).alias("plan"))
    days = traded.groupBy(*DAY).agg(F.sort_array(F.collect_list(bar)).alias("bars"))
    return _resolve(days, risk.hold_bars)


def _resolve(days: DataFrame, hold_bars: int) -> DataFrame:
    """The first barrier of each signal of a day. Inside a bar the stop outranks the
    target; a day that ends sooner than ``hold_bars`` closes the trade."""
    levels = range(max(hold_bars, 1).bit_length())
    tables = {}
    for name, best in (("low", "least"), ("high", "greatest")):
        # Behind the end the ranges are shorter: zip_with pads with nulls, which least and greatest pass over.
        halves = f"zip_with(get(acc, j - 1), slice(get(acc, j - 1), shiftleft(1, j - 1) + 1, size(bars)), (x, y) -> {best}(x, y))"
        first = f"array(transform(bars, b -> b.{name}))"
        tables[name] = f"aggregate({_ints(levels[1:])}, {first}, (acc, j) -> array_append(acc, {halves}))"
    # What keeps a trade open: lows above the lower barrier and highs below the upper one.
    # A barrier that is null is never touched.
    signals = """filter(transform(bars, (b, i) -> named_struct('at', i, 'bar', b,
            'room', least({hold}, size(bars) - 1 - i),
            'lower', coalesce(if(b.plan.side = 'long', b.plan.stop, b.plan.target), double('-inf')),
            'upper', coalesce(if(b.plan.side = 'long', b.plan.target, b.plan.stop), double('inf')))),
        e -> e.bar.plan is not null)""".format(hold=max(hold_bars, 0))
    free = f"""aggregate({_ints(reversed(levels))}, e.at + 1, (p, j) -> if(
            p + shiftleft(1, j) <= e.at + 1 + e.room and get(get(lows, j), p) > e.lower and get(get(highs, j), p) < e.upper,
            p + shiftleft(1, j), p)) - e.at - 1"""
    searched = (
        days.selectExpr("*", f"{tables['low']} as lows", f"{tables['high']} as highs", f"{signals} as signals")
        .selectExpr(*DAY, "bars", f"transform(signals, e -> named_struct('e', e, 'free', {free})) as found")
    )
    stopped = "if(f.e.bar.plan.side = 'long', get(bars, f.e.at + 1 + f.free).low <= f.e.bar.plan.stop, get(bars, f.e.at + 1 + f.free).high >= f.e.bar.plan.stop)"
    outcome = f"""named_struct('e', f.e, 'held', if(f.free < f.e.room, f.free + 1, f.e.room),
        'exit', get(bars, f.e.at + if(f.free < f.e.room, f.free + 1, f.e.room)),
        'exit_reason', case when f.free < f.e.room and {stopped} then '{STOP}'
                            when f.free < f.e.room then '{TARGET}'
                            when f.e.room >= {hold_bars} then '{TIME}' else '{DAY_END}' end)"""
    resolved = searched.selectExpr(*DAY, f"inline(filter(transform(found, f -> {outcome}), o -> o.held > 0))")
    return resolved.selectExpr(
        *DAY,
        "e.bar.bar_idx as entry_idx",
        "e.bar.bar_idx + held as exit_idx",
        "e.bar.ts as entry_time",
        "exit.ts as exit_time",
        "e.bar.local_ts as entry_local",
        "exit.local_ts as exit_local",
        "e.bar.plan.side as side",
        "e.bar.close as entry_price",
        f"""case exit_reason when '{STOP}' then e.bar.plan.stop when '{TARGET}' then e.bar.plan.target
                 else exit.close end as exit_price""",
        "held as bars_held",
        f"exit_reason = '{TARGET}' as hit_target",
        "e.bar.plan.trend as trend",
        "e.bar.plan.reason as reason",
        "exit_reason",
        "e.bar.plan.target as target_price",
        "e.bar.plan.stop as stop_price",
    )


def _ints(values: Iterable[int]) -> str:
    return f"cast(array({', '.join(map(str, values))}) as array<int>)"


def non_overlapping(candidates: DataFrame) -> DataFrame:
    """Greedy choice by time: take a candidate if no taken one is still open. The
    exit bar of a trade may open the next.

    Days are independent, as no trade outlives its day. Inside a day, candidates
    are split where every earlier one is already closed. Within such a run each has a
    pointer to the first one that starts at or after its exit (binary search), and the
    chain of the first is what is taken. Pointers are doubled: with the k-th table what
    is 2^k steps behind is known, and the chain found so far doubles. So n candidates
    cost O(n log n), however they overlap.
    """
    in_day = "over (partition by symbol, block, session_date order by entry_idx rows between unbounded preceding"
    runs = candidates.selectExpr(
        "*", f"entry_idx >= coalesce(max(exit_idx) {in_day} and 1 preceding), -1) as opens_run"
    ).selectExpr(*candidates.columns, f"count_if(opens_run) {in_day} and current row) as run")

    fields = ["entry_idx", *[c for c in candidates.columns if c not in (*DAY, "entry_idx")]]
    grouped = runs.groupBy(*DAY, "run").agg(F.expr(f"sort_array(collect_list(struct({', '.join(fields)}))) as queue"))
    powers = "transform(sequence(1, cast(ceil(log2(size(queue) + 1)) as int)), k -> shiftleft(1, cast(ceil(log2(size(queue) + 1)) as int) - k))"
    follower = "aggregate(powers, 0, (p, step) -> if(p + step <= size(starts) and get(starts, p + step - 1) < c.exit_idx, p + step, p))"
    doubled = f"""aggregate(powers, named_struct('next', array_append(transform(queue, c -> {follower}), size(queue)), 'chain', array(0)),
        (acc, step) -> named_struct(
            'next', transform(acc.next, i -> get(acc.next, i)),
            'chain', concat(acc.chain, filter(transform(acc.chain, i -> get(acc.next, i)), i -> i < size(queue)))),
        acc -> acc.chain)"""
    prepared = grouped.selectExpr("*", "transform(queue, c -> c.entry_idx) as starts", f"{powers} as powers")
    return prepared.selectExpr(*DAY, "queue", f"{doubled} as chain").selectExpr(*DAY, "inline(transform(chain, i -> get(queue, i)))")
