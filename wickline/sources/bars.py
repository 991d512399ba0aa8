"""Bar tables: reading, building from ticks, normalising, session filter."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wickline.functions.clock import in_session, require_utc, utc_instant, wall_clock
from wickline.params import Session

PRICES = ("open", "high", "low", "close")
REQUIRED = (*PRICES, "volume")
BAR_COLUMNS = ("symbol", "ts", "local_ts", "session_date", *REQUIRED)


def normalize_columns(df: DataFrame) -> DataFrame:
    """Lower-case the column names, keep the first level of two-level headers
    (``close|SPY`` style names split at ``|``), check OHLCV is present, and turn
    NaN into null so that one kind of missing value is left."""
    renamed = df.select([F.col(f"`{c}`").alias(c.split("|")[0].strip().lower()) for c in df.columns])
    missing = sorted(set(REQUIRED) - set(renamed.columns))
    if missing:
        raise ValueError(f"a bar table needs the columns {missing}")
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in REQUIRED}
    return renamed.withColumns(clean)


def localize(df: DataFrame, timezone: str, ts: str = "ts") -> DataFrame:
    """Add the wall clock and the local date of the session zone. Zone-less
    timestamps are UTC."""
    require_utc(df.sparkSession)
    return (
        df.withColumn(ts, utc_instant(F.col(ts)))
        .withColumn("local_ts", wall_clock(F.col(ts), timezone))
        .withColumn("session_date", F.to_date("local_ts"))
    )


def session_filter(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.where(in_session(F.col("local_ts"), start, end))


def drop_incomplete_bars(df: DataFrame) -> DataFrame:
    """Drop rows without a full set of prices; a missing volume survives."""
    return df.dropna(subset=list(PRICES))


def nan_to_null(df: DataFrame) -> DataFrame:
    """One kind of missing value in the numbers of a bar."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in REQUIRED if kinds.get(c) in ("double", "float")})


def unique_bars(bars: DataFrame) -> DataFrame:
    """One bar per (symbol, ts). Repeated ones are taken as sights of the same bar:
    highest high and close, lowest low and open, largest volume. The values are
    combined before the shuffle, and don't depend on the order of rows."""
    pick = {"open": F.min, "high": F.max, "low": F.min, "close": F.max, "volume": F.max}
    merged = bars.groupBy("symbol", "ts").agg(
        F.min("local_ts").alias("local_ts"),
        F.min("session_date").alias("session_date"),
        *[pick[c](c).alias(c) for c in REQUIRED],
    )
    return merged.select(*BAR_COLUMNS)


def session_bars(df: DataFrame, session: Session) -> DataFrame:
    """Raw bar table to session bars with exactly the columns of a bar."""
    local = localize(normalize_columns(df), session.timezone)
    inside = session_filter(local, session.start, session.end)
    return drop_incomplete_bars(inside).select(*BAR_COLUMNS)


def near_dates(raw: DataFrame, name: str, start: str | None, end: str | None) -> DataFrame:
    """Rows whose stored date is at most a day off [start, end]: a coarse cut that
    partition pruning understands, whatever zone the dates were made in."""
    if start is not None:
        raw = raw.where(F.col(name) >= F.date_sub(F.lit(start).cast("date"), 1))
    if end is not None:
        raw = raw.where(F.col(name) <= F.date_add(F.lit(end).cast("date"), 1))
    return raw


def read_bars(
    spark: SparkSession,
    path: str,
    symbols: Iterable[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    session: Session = Session(),
    fmt: str = "parquet",
    schema: str | None = None,
    strict: bool = False,
    unique: bool = True,
) -> DataFrame:
    """Session bars of the given symbols with ts in [start, end).

    The predicates on symbol and ts reach the scan; a stored ``session_date`` also
    prunes partitions, with a day to spare on both sides. Repeated bars of a symbol
    and time are merged, unless the caller knows that there are none and saves the
    shuffle with ``unique=False``. ``strict`` runs a one-row probe and raises if
    nothing is there; it is off by default because a probe is a Spark job of its own.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "csv":
        reader = reader.option("header", True)
    raw = reader.format(fmt).load(path)
    by_name = {c.lower(): c for c in raw.columns}
    if symbols is not None:
        raw = raw.where(F.col(by_name["symbol"]).isin(*symbols))
    if "session_date" in by_name:
        raw = near_dates(raw, by_name["session_date"], start, end)
    bound_type = dict(raw.dtypes)[by_name["ts"]]
    if start is not None:
        raw = raw.where(F.col(by_name["ts"]) >= F.lit(start).cast(bound_type))
    if end is not None:
        raw = raw.where(F.col(by_name["ts"]) < F.lit(end).cast(bound_type))
    if strict and raw.limit(1).count() == 0:
        raise ValueError("no bars for these symbols and dates")
    bars = session_bars(raw, session)
    return unique_bars(bars) if unique else bars


def build_bars(
    ticks: DataFrame,
    width: str,
    session: Session = Session(),
    price: Column | str = "price",
    order: Column | str = "ts",
    volume: Column | None = None,
) -> DataFrame:
    """OHLCV bars of one width from ticks (symbol, ts, price).

    One aggregation with map-side combine: what is shuffled is one partial row
    per bar and input partition, however many ticks a symbol or a bar has.
    ``order`` decides which tick is first and last; ``volume`` is the number of
    ticks unless given. A missing or NaN size counts nothing, a tick without a price
    isn't one. The hour that the clocks repeat gives bars of its own for widths up
    to an hour; wider bars span it.
    """
    price_col = F.col(price) if isinstance(price, str) else price
    order_col = F.col(order) if isinstance(order, str) else order
    size = F.count(F.lit(1)).cast("double")
    if volume is not None:
        size = F.sum(F.nanvl(volume.cast("double"), F.lit(None)))
    priced = ticks.where(price_col.isNotNull() & ~F.isnan(price_col.cast("double")))
    inside = session_filter(localize(priced, session.timezone), session.start, session.end)
    bar = F.window("local_ts", width)
    offset = F.unix_seconds(F.col("local_ts").cast("timestamp")) - F.unix_seconds("ts")
    windowed = inside.withColumn("bar", bar).withColumn(
        "shift", F.when(F.col("bar.end") - F.col("bar.start") <= F.expr("interval 1 hour"), offset)
    )
    bars = windowed.groupBy("symbol", "bar", "shift").agg(
        F.min("ts").alias("first_ts"),
        F.min("local_ts").alias("first_local"),
        F.min_by(price_col, order_col).alias("open"),
        F.max(price_col).alias("high"),
        F.min(price_col).alias("low"),
        F.max_by(price_col, order_col).alias("close"),
        size.alias("volume"),
    )
    # The bar starts as long before its first tick on the UTC axis as on the wall clock.
    bar_ts = F.col("first_ts") - (F.col("first_local") - F.col("bar.start"))
    keyed = bars.withColumn("ts", bar_ts).withColumn("local_ts", F.col("bar.start"))
    dated = keyed.withColumn("session_date", F.to_date("local_ts"))
    return drop_incomplete_bars(dated).select(*BAR_COLUMNS)
