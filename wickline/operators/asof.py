"""As-of price look-up: the first quote at or after a moment, else the last
before it, within given local dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def near_stored_dates(quotes: DataFrame, moments: DataFrame) -> DataFrame:
    """Quotes stored under a date within a day of some moment's local date. The dates
    are a calendar, so their broadcast is bounded, and the scan of a table that is
    partitioned by them is pruned at run time."""
    near = F.explode(F.array(*[F.date_add("session_date", k) for k in (-1, 0, 1)]))
    dates = moments.where("session_date >= DATE'0001-01-02'").select(near.alias("stored_date")).distinct()
    return quotes.join(F.broadcast(dates), "stored_date", "left_semi")


def asof_prices(lookups: DataFrame, quotes: DataFrame, key: tuple[str, ...] = ("symbol", "entry_time")) -> DataFrame:
    """``entry_quote``, ``exit_quote`` and ``quoted`` (any quote at all) for
    look-ups (symbol, entry_time, exit_time, ticker, first_date, last_date), one per
    value of ``key``.

    Quotes and moments are merged in time order per (ticker, date), so that each
    moment sees its neighbours by two running windows: no pairs are formed, and a
    busy ticker is spread over its dates.
    """
    moments = lookups.select(
        "ticker",
        F.explode(F.sequence("first_date", "last_date")).alias("session_date"),
        *key,
        F.explode(
            F.array(
                F.struct(F.lit("entry").alias("leg"), F.col("entry_time").alias("ts")),
                F.struct(F.lit("exit").alias("leg"), F.col("exit_time").alias("ts")),
            )
        ).alias("moment"),
    ).select("ticker", "session_date", F.col("moment.ts").alias("ts"), *key, "moment.leg")
    if "stored_date" in quotes.columns:
        quotes = near_stored_dates(quotes, moments)
    marked = quotes.select("ticker", "session_date", "ts", F.struct("ts", "close").alias("quote"))
    days = ["ticker", "session_date"]
    relevant = marked.join(moments.select(*days).distinct(), days, "left_semi")
    merged = relevant.unionByName(moments, allowMissingColumns=True)

    # At equal times a quote must be seen from both sides: it sorts first either way.
    is_moment = F.col("quote").isNull().cast("int")
    day = Window.partitionBy(*days)
    so_far = (Window.unboundedPreceding, Window.currentRow)
    back = F.last("quote", ignorenulls=True).over(day.orderBy(F.asc("ts"), is_moment).rowsBetween(*so_far))
    ahead = F.last("quote", ignorenulls=True).over(day.orderBy(F.desc("ts"), is_moment).rowsBetween(*so_far))
    seen = merged.withColumns({"back": back, "ahead": ahead}).where("quote is null")
    return seen.groupBy(*key).agg(
        *[
            F.expr(
                f"coalesce(min(ahead) filter (where leg = '{leg}'), max(back) filter (where leg = '{leg}')).close"
            ).alias(f"{leg}_quote")
            for leg in ("entry", "exit")
        ],
        F.expr("bool_or(coalesce(ahead, back) is not null)").alias("quoted"),
    )
