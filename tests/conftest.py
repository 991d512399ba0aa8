from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from helpers import clock  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("wickline-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


BAR_SCHEMA = (
    "symbol string, local_ts timestamp_ntz, open double, high double, low double, close double, volume double"
)


@pytest.fixture(scope="session")
def make_bars(spark):
    """Bars from rows (symbol, local time, open, high, low, close, volume)."""
    from pyspark.sql import functions as F

    from wickline.sources.bars import BAR_COLUMNS

    def make(rows):
        raw = spark.createDataFrame(rows, BAR_SCHEMA)
        placed = raw.withColumns(
            {
                "ts": F.to_utc_timestamp(F.col("local_ts").cast("timestamp"), "America/New_York"),
                "session_date": F.to_date("local_ts"),
            }
        )
        return placed.select(*BAR_COLUMNS)

    return make


@pytest.fixture(scope="session")
def random_walk():
    """Seeded walks with gaps in the calendar, a null volume and a flat stretch."""
    import numpy as np

    def walk(symbol: str, seed: int, days: int = 40, per_day: int = 13, step: int = 3):
        rng = np.random.default_rng(seed)
        price, rows = 100.0 + seed, []
        for d in range(days):
            for b in range(per_day if d % 7 else 1):
                start = price
                if not 11 <= d <= 12:
                    price = round(price + float(rng.normal(0, 0.6)), 4)
                high = max(start, price) + abs(round(float(rng.normal(0, 0.2)), 4))
                low = min(start, price) - abs(round(float(rng.normal(0, 0.2)), 4))
                volume = None if (d, b) == (20, 5) else float(rng.integers(500, 5000))
                rows.append((symbol, clock(d * step, b), start, high, low, price, volume))
        return rows

    return walk
