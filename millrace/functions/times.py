"""Time arithmetic that does not depend on the session time zone (timestamps without a zone are UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1970-01-01"


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(c: str | Column) -> Column:
    """Whole seconds since 1970 (floor), bigint; null for null."""
    c = as_col(c)
    days = F.datediff(F.to_date(c), F.lit(EPOCH).cast("date")).cast("bigint")
    return days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def epoch_hours(c: str | Column) -> Column:
    c = as_col(c)
    return F.datediff(F.to_date(c), F.lit(EPOCH).cast("date")).cast("bigint") * 24 + F.hour(c)


def yyyymmdd(c: str | Column) -> Column:
    c = as_col(c)
    return F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)


def yyyymm(c: str | Column) -> Column:
    c = as_col(c)
    return F.year(c) * 100 + F.month(c)
