"""Rows of hand-made bars."""

from __future__ import annotations

import datetime as dt


def clock(day: int, bar: int, minutes: int = 5, month: int = 3) -> dt.datetime:
    return dt.datetime(2024, month, 1, 9, 30) + dt.timedelta(days=day, minutes=minutes * bar)


def flat(symbol: str, when: dt.datetime, price: float, volume: float | None = 1000.0) -> tuple:
    return (symbol, when, price, price, price, price, volume)
