"""Option contracts, chains and option bars: layouts brought to one schema."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickline.functions.clock import require_utc, utc_instant, wall_clock
from wickline.sources.bars import near_dates

LISTING_DAYS = 14


def read_option_contracts(
    raw: DataFrame,
    underlying: str | None = None,
    contract_type: str | None = None,
    as_of: str | None = None,
) -> DataFrame:
    """Contracts as listed on ``as_of``: (underlying, contract_type, as_of,
    expiration, strike, ticker). Unreadable dates and strikes become null; what
    expires before the listing date or over two weeks after it is left out.
    """
    df = raw
    if underlying is not None:
        df = df.where(F.col("underlying") == underlying)
    if contract_type is not None:
        df = df.where(F.col("contract_type") == contract_type)
    if as_of is not None:
        df = df.where(F.col("as_of") == F.lit(as_of).cast("date"))
    typed = df.select(
        "underlying",
        "contract_type",
        F.col("as_of").cast("date").alias("as_of"),
        F.col("expiration_date").try_cast("date").alias("expiration"),
        F.nanvl(F.col("strike_price").try_cast("double"), F.lit(None)).alias("strike"),
        F.nullif(F.col("ticker"), F.lit("")).alias("ticker"),
    )
    soon = F.col("expiration").between(F.col("as_of"), F.date_add("as_of", LISTING_DAYS))
    return typed.where(F.col("expiration").isNull() | soon)


def read_contract_intervals(raw: DataFrame) -> DataFrame:
    """Contracts with the days they are listed from and to, both inclusive, a row per
    contract: (underlying, contract_type, listed_from, listed_to, expiration, strike,
    ticker). An open end is null. Only the two weeks before an expiry are kept, as no
    look-up asks for more; contracts without a readable expiry are left out."""
    typed = raw.select(
        "underlying",
        "contract_type",
        F.col("listed_from").cast("date").alias("listed_from"),
        F.col("listed_to").cast("date").alias("listed_to"),
        F.col("expiration_date").try_cast("date").alias("expiration"),
        F.nanvl(F.col("strike_price").try_cast("double"), F.lit(None)).alias("strike"),
        F.nullif(F.col("ticker"), F.lit("")).alias("ticker"),
    ).where("expiration is not null")
    first = F.greatest("listed_from", F.date_sub("expiration", LISTING_DAYS))  # both pass over nulls
    clipped = typed.withColumns({"listed_from": first, "listed_to": F.least("listed_to", "expiration")})
    return clipped.where("listed_from <= listed_to")


def listed_on(intervals: DataFrame, requests: DataFrame, bucket_days: int = 16) -> DataFrame:
    """The contracts of ``intervals`` as listed on the days of ``requests`` (symbol,
    contract_type, as_of), in the layout of ``read_option_contracts``. An interval is in
    each bucket of days it meets, two at most; days look into their own bucket, so this
    is an equi-join, and no contract gets a row for a day that nobody asks for."""
    bucket = lambda day: F.floor(F.unix_date(day) / bucket_days)
    spread = intervals.withColumn("bucket", F.explode(F.sequence(bucket("listed_from"), bucket("listed_to"))))
    days = requests.select(F.col("symbol").alias("underlying"), "contract_type", "as_of").distinct().withColumn("bucket", bucket("as_of"))
    met = spread.join(days, ["underlying", "contract_type", "bucket"]).where("as_of between listed_from and listed_to")
    return met.select("underlying", "contract_type", "as_of", "expiration", "strike", "ticker")


def read_option_chain(
    raw: DataFrame, underlying: str | None = None, expiration: str | None = None, contract_type: str | None = None
) -> DataFrame:
    """Chain rows (underlying, contract_type, expiration, strike, contract),
    whatever the day they were listed on."""
    df = raw
    if underlying is not None:
        df = df.where(F.col("underlying") == underlying)
    if contract_type is not None:
        df = df.where(F.col("contract_type") == contract_type)
    typed = df.select(
        "underlying",
        "contract_type",
        F.col("expiration").try_cast("date").alias("expiration"),
        F.nanvl(F.col("strike").try_cast("double"), F.lit(None)).alias("strike"),
        F.col("contractSymbol").alias("contract"),
    )
    if expiration is not None:
        typed = typed.where(F.col("expiration") == F.lit(expiration).cast("date"))
    return typed


def _quotes(df: DataFrame, ts: Column, close: Column, timezone: str) -> DataFrame:
    """(ticker, ts, close, session_date); a date that the table stores (it may be a
    partition column) is kept as ``stored_date``, by which look-ups prune."""
    require_utc(df.sparkSession)
    stored = [F.col("session_date").cast("date").alias("stored_date")] if "session_date" in df.columns else []
    instant = df.select(F.col("ticker"), ts.alias("ts"), close.cast("double").alias("close"), *stored)
    return instant.withColumn("session_date", F.to_date(wall_clock(F.col("ts"), timezone)))


def _within(raw: DataFrame, tickers: Iterable[str] | None, start: str | None, end: str | None) -> DataFrame:
    """Coarse cut that reaches the scan: tickers, and stored dates within a day of [start, end]."""
    if tickers is not None:
        raw = raw.where(F.col("ticker").isin(*tickers))
    return near_dates(raw, "session_date", start, end) if "session_date" in raw.columns else raw


def _between(quotes: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Quotes of the local dates [start, end], exactly."""
    if start is not None:
        quotes = quotes.where(F.col("session_date") >= F.lit(start).cast("date"))
    return quotes if end is None else quotes.where(F.col("session_date") <= F.lit(end).cast("date"))


def read_option_bars_agg(
    raw: DataFrame, timezone: str, tickers: Iterable[str] | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Service layout: ``t`` is epoch milliseconds, ``c`` the close. ``start`` and
    ``end`` are local dates, both inclusive; they bound ``t`` with a day to spare
    before they are applied exactly."""
    near = _within(raw, tickers, start, end)
    day = 86_400_000
    if start is not None:
        near = near.where(F.col("t") >= F.unix_date(F.lit(start).cast("date")).cast("long") * day - day)
    if end is not None:
        near = near.where(F.col("t") < F.unix_date(F.lit(end).cast("date")).cast("long") * day + 2 * day)
    quotes = _quotes(near, F.timestamp_millis("t"), F.nanvl(F.col("c").cast("double"), F.lit(None)), timezone)
    return _between(quotes, start, end)


def read_option_bars_ohlc(
    raw: DataFrame, timezone: str, tickers: Iterable[str] | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Bar layout: named columns in any case; without a close column, no rows."""
    df = raw.select([F.col(f"`{c}`").alias(c.split("|")[0].strip().lower()) for c in raw.columns])
    near = _within(df, tickers, start, end)
    if "close" not in df.columns:
        return _quotes(near, utc_instant(F.col("ts")), F.lit(None), timezone).limit(0)
    quotes = _quotes(near, utc_instant(F.col("ts")), F.nanvl(F.col("close").cast("double"), F.lit(None)), timezone)
    return _between(quotes, start, end)
