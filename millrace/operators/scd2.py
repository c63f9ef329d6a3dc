"""Slowly changing dimensions, type 2, as a pure function of the current table, the source and a time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.merge import require_unique


def timestamp(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def scd2_initial(source: DataFrame, key: str, tracked: list[str], now: str) -> DataFrame:
    """Every source row as the current version from `now` on. Rows with a null key are dropped."""
    rows = require_unique(source.filter(F.col(key).isNotNull()).select(key, *tracked), [key])
    return rows.select(key, *tracked, timestamp(now).alias("effective_from"), F.lit(None).cast("timestamp_ntz").alias("effective_to"), F.lit(True).alias("is_current"))


@dataclass
class Change:
    """The new dimension, and the keys that were inserted or expired."""

    dimension: DataFrame
    inserted: DataFrame
    expired: DataFrame

    def counts(self) -> dict[str, int]:
        return {"inserted": self.inserted.count(), "expired": self.expired.count()}


def scd2_apply(dimension: DataFrame | None, source: DataFrame, key: str, tracked: list[str], now: str) -> Change:
    """Compares the source with the current versions, null-safely by column: changed keys are expired and inserted
    anew at one and the same `now`, new keys inserted. Keys that the source no longer has stay current. Keys that
    the source repeats are refused."""
    if dimension is None:
        first = scd2_initial(source, key, tracked, now)
        return Change(first, first.select(key), first.select(key).limit(0))
    src = require_unique(source.filter(F.col(key).isNotNull()).select(key, *tracked), [key])
    cur = dimension.filter("is_current").select(F.col(key).alias("_key"), F.struct(*tracked).alias("_old"))
    met = src.join(cur, src[key] == F.col("_key"), "left")
    moved = met.filter(F.col("_key").isNull() | ~F.struct(*[src[c] for c in tracked]).eqNullSafe(F.col("_old")))
    insert = moved.select(src[key], *[src[c] for c in tracked], timestamp(now).alias("effective_from"), F.lit(None).cast("timestamp_ntz").alias("effective_to"), F.lit(True).alias("is_current"))
    expired = moved.filter("_key IS NOT NULL").select(F.col("_key").alias("_expired"))
    held = dimension.join(expired, (dimension[key] == F.col("_expired")) & dimension["is_current"], "left")
    gone = F.col("_expired").isNotNull()
    kept = held.select(*[
        F.when(gone, timestamp(now)).otherwise(F.col(c)).alias(c) if c == "effective_to"
        else (F.col(c) & ~gone).alias(c) if c == "is_current" else dimension[c] for c in dimension.columns])
    return Change(kept.unionByName(insert, allowMissingColumns=True), insert.select(key), expired.select(F.col("_expired").alias(key)))
