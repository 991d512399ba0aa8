"""Time-zone and session arithmetic as column expressions, for sessions in UTC."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def require_utc(spark: SparkSession) -> None:
    """The functions below read the UTC axis through the session zone."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC, not {zone}")


def wall_clock(ts: Column, timezone: str) -> Column:
    """Local wall clock (timestamp_ntz) of an instant column."""
    return F.from_utc_timestamp(ts, timezone).cast("timestamp_ntz")


def utc_instant(ts: Column) -> Column:
    """Instant of a timestamp column; a zone-less one is read as UTC."""
    return ts.cast("timestamp")


def local_midnight(day: Column, timezone: str) -> Column:
    """Instant at which a calendar date starts in a zone."""
    return F.to_utc_timestamp(day.cast("timestamp"), timezone)


def local_date_after(ts: Column, days: int, timezone: str) -> Column:
    """Local date reached ``days`` periods of 24 hours after an instant."""
    shifted = ts + F.make_dt_interval(F.lit(0), F.lit(24 * days))
    return F.to_date(wall_clock(shifted, timezone))


def second_of_day(local_ts: Column) -> Column:
    return F.pmod(F.unix_seconds(local_ts.cast("timestamp")), F.lit(86_400))


def seconds_from_clock(text: str) -> int:
    """``"09:30"`` or ``"09:30:15"`` as seconds after midnight."""
    parts = [int(p) for p in text.split(":")] + [0]
    return parts[0] * 3600 + parts[1] * 60 + parts[2]


def in_session(local_ts: Column, start: str, end: str) -> Column:
    """Wall-clock time in [start, end); start > end wraps over midnight and
    start = end selects nothing."""
    opens, closes = seconds_from_clock(start), seconds_from_clock(end)
    since_open = F.pmod(second_of_day(local_ts) - opens, F.lit(86_400))
    return since_open < (closes - opens) % 86_400
