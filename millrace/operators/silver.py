"""Raw rows to trusted rows: standardise, deduplicate, flag, derive, hash and split. Pure DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.contract import SILVER_COLUMNS, TRIPS, FeedContract
from millrace.functions.hashing import surrogate_hash
from millrace.functions.rounding import ROUNDINGS
from millrace.functions.times import epoch_seconds


def standardize(df: DataFrame, contract: FeedContract = TRIPS) -> DataFrame:
    """The contract's columns in order, then lineage columns that are there; one select.

    Names are matched without case; a value that cannot be read as its type, and a column that is
    absent, become typed nulls. Further columns are dropped. Where several source columns stand for
    one target, the first value that is not null holds.
    """
    names: dict[str, list[str]] = {}
    renames = {k.lower(): v for k, v in contract.renames.items()}
    for c in df.columns:
        names.setdefault(renames.get(c.lower(), c.lower()), []).append(c)

    def read(target: str, kind: str) -> Column:
        found = [F.col(f"`{c}`").try_cast(kind) for c in names.get(target, [])]
        return (F.coalesce(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast(kind)).alias(target)

    lineage = [F.col(f"`{c}`") for c in contract.lineage if c in df.columns]
    return df.select(*[read(t, k) for t, k in contract.columns.items()], *lineage)


def latest_per_key(df: DataFrame, key: list[str], arrived: str = "_ingested_at", tie_breakers: list[str] | None = None) -> DataFrame:
    """One row per key: the one that arrived last.

    Ties, and rows without an arrival (which come first), are ordered by the tie breakers, by default
    all columns, so the result is the same in any partitioning. Null keys are one group. It is an
    aggregation with map-side combine, so a key that holds a third of all rows leaves each split as
    one row.
    """
    order = [arrived] if arrived in df.columns else []
    order += [c for c in (tie_breakers or df.columns) if c not in order]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def flag_violations(df: DataFrame, contract: FeedContract = TRIPS, name: str = "dq_violations") -> DataFrame:
    """Adds the names of the broken rules, in the contract's order; an empty array is a clean row."""
    seconds = epoch_seconds(contract.end) - epoch_seconds(contract.start)
    out = df.withColumn("_seconds", seconds) if any("{seconds}" in r.bad_when for r in contract.rules) else df
    checks = [F.when(F.expr(r.bad_when.format(seconds="_seconds")), F.lit(r.name)) for r in contract.rules]
    return out.withColumn(name, F.array_compact(F.array(*checks))).drop("_seconds")


def derive(df: DataFrame, contract: FeedContract = TRIPS, rounding: str = "half_up") -> DataFrame:
    """Adds date, hour, minutes, speed, tip share and hash. Speed needs minutes > 0, the tip share a fare > 0; else null."""
    rnd = ROUNDINGS[rounding]
    minutes = rnd((epoch_seconds(contract.end) - epoch_seconds(contract.start)) / 60.0)
    out = df.withColumns({"pickup_date": F.to_date(contract.start), "pickup_hour": F.hour(contract.start), "trip_minutes": minutes})
    return out.withColumns({
        "avg_speed_mph": F.when(F.col("trip_minutes") > 0, rnd(F.col("trip_distance") / (F.col("trip_minutes") / 60.0))),
        "tip_pct": F.when(F.col("fare_amount") > 0, rnd(F.col("tip_amount") / F.col("fare_amount") * 100.0)),
        "trip_hash": surrogate_hash(df, contract.key),
    })


def tagged(raw: DataFrame, contract: FeedContract = TRIPS, rounding: str = "half_up") -> DataFrame:
    """All steps in order; clean and bad rows in one frame. A bad later row displaces a good earlier one."""
    return derive(flag_violations(latest_per_key(standardize(raw, contract), contract.key), contract), contract, rounding)


def split(rows: DataFrame, name: str = "dq_violations") -> tuple[DataFrame, DataFrame]:
    """(clean without the array, quarantine with it)."""
    return rows.filter(F.size(name) == 0).drop(name), rows.filter(F.size(name) > 0)


def silver_columns(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*SILVER_COLUMNS, *more)


def quarantine_reasons(quarantine: DataFrame, name: str = "dq_violations") -> DataFrame:
    """(reasons, n): how often each combination of rules was broken."""
    return quarantine.groupBy(F.array_join(name, ", ").alias("reasons")).agg(F.count("*").alias("n"))
