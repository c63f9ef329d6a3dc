"""Surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands between the parts of a surrogate key, and for a null part.
SEPARATOR, NULL_TOKEN = "||", "<null>"


def surrogate_hash(df: DataFrame, columns: list[str]) -> Column:
    """Lower-case hex SHA-256 of the columns as text, joined; nulls have a token of their own, -0.0 is 0.0.

    Timestamps are text as in `2024-01-15 08:00:00`, doubles as Java writes them.
    """
    kinds = {c.lower(): t for c, t in df.dtypes}
    parts = []
    for c in columns:
        v = F.col(c) + F.lit(0.0) if kinds[c.lower()] in ("double", "float") else F.col(c)
        parts.append(F.coalesce(v.cast("string"), F.lit(NULL_TOKEN)))
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)
