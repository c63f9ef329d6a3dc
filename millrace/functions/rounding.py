"""Rounding to decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column, digits: int = 2) -> Column:
    """Half away from zero on the decimal text of the double (1.005 gives 1.01)."""
    return F.round(c, digits)


def by_floor(c: Column, digits: int = 2) -> Column:
    """floor(x * 10^d + 0.5) / 10^d on doubles: the same in any engine, but 1.005 gives 1.0."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


ROUNDINGS = {"half_up": half_up, "floor": by_floor}
