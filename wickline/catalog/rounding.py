"""Decimals at which the results of two engines are compared."""

from __future__ import annotations

# Products of a four-decimal price and a percentage often end in an exact tie at
# the seventh decimal, which engines round differently.
EXIT_PRICES = ("exit_price", "target_price", "stop_price", "underlying_exit_price")


def decimals(column: str) -> int:
    return 4 if column in EXIT_PRICES else 6
