"""Reconciliation between layers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.contract import TRIPS, FeedContract
from millrace.functions.hashing import surrogate_hash
from millrace.operators.gold import money
from millrace.operators.silver import standardize

RESULT_COLUMNS = ["check_name", "scope", "source_value", "target_value", "difference", "passed"]


class ReconError(RuntimeError):
    """Checks failed; their results are stored."""


def compared(df: DataFrame, name: str | Column, scope: str | Column, tolerance: float = 0.0) -> DataFrame:
    """df(source_value, target_value) as check results: passed if they differ by at most the tolerance; null counts as 0."""
    name, scope = (F.lit(x) if isinstance(x, str) else x for x in (name, scope))
    s, t = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("source_value", "target_value"))
    return df.select(name.alias("check_name"), scope.alias("scope"), s.alias("source_value"), t.alias("target_value"), F.abs(s - t).alias("difference"), (F.abs(s - t) <= tolerance).alias("passed"))


def compare(source: float | None, target: float | None, tolerance: float = 0.0) -> tuple[float, bool]:
    """(difference, passed) of two numbers on the driver."""
    d = abs(float(source or 0) - float(target or 0))
    return d, d <= tolerance


def _side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row frames as one row, without a join: both are added up under their own column."""
    x = a.select(F.col("v").cast("double").alias("source_value"), F.lit(None).cast("double").alias("target_value"))
    y = b.select(F.lit(None).cast("double").alias("source_value"), F.col("v").cast("double").alias("target_value"))
    return x.unionByName(y).agg(F.max("source_value").alias("source_value"), F.max("target_value").alias("target_value"))


def source_vs_bronze(manifest: DataFrame, bronze: DataFrame, file: str = "_source_file") -> DataFrame:
    """Rows per landed file (the largest count of the manifest) against rows in bronze; a file on one side only has 0 on the other."""
    m = manifest.filter("status = 'LANDED'").groupBy(F.col("file_name").alias("_m")).agg(F.max("source_row_count").alias("source_value"))
    b = bronze.groupBy(F.col(file).alias("_b")).agg(F.count("*").alias("target_value"))
    both = m.join(b, F.col("_m") == F.col("_b"), "full_outer")
    return compared(both, "src_vs_bronze_rows", F.coalesce("_m", "_b"))


def bronze_vs_silver(bronze: DataFrame, clean: DataFrame, quarantine: DataFrame, contract: FeedContract = TRIPS, key: str = "trip_hash") -> DataFrame:
    """Distinct business keys of bronze against distinct hashes of clean and quarantine together."""
    rows = standardize(bronze, contract)
    a = rows.select(surrogate_hash(rows, contract.key).alias("h")).agg(F.countDistinct("h").alias("v"))
    b = clean.select(key).unionByName(quarantine.select(key)).agg(F.countDistinct(key).alias("v"))
    return compared(_side_by_side(a, b), "bronze_distinct_keys_vs_silver_total", "all")


def clean_and_quarantined(clean: DataFrame, quarantine: DataFrame, key: str = "trip_hash") -> DataFrame:
    """Keys that are in both; there should be none."""
    both = clean.select(key).distinct().join(quarantine.select(key), key, "left_semi").agg(F.count("*").alias("v"))
    return compared(both.select(F.col("v").alias("source_value"), F.lit(0).alias("target_value")), "clean_and_quarantined_keys", "all")


def rows_equal(source: DataFrame, target: DataFrame, name: str = "silver_vs_fact_rows") -> DataFrame:
    return compared(_side_by_side(source.agg(F.count("*").alias("v")), target.agg(F.count("*").alias("v"))), name, "all")


def amounts_equal(source: DataFrame, target: DataFrame, column: str = "total_amount", tolerance: float = 0.01, name: str = "silver_vs_fact_total_amount") -> DataFrame:
    return compared(_side_by_side(source.agg(money(column).alias("v")), target.agg(money(column).alias("v"))), name, "all", tolerance)


def fact_vs_mart(fact: DataFrame, daily: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Revenue of the fact against the mart, which is rounded per group."""
    return compared(_side_by_side(fact.agg(money("total_amount").alias("v")), daily.agg(money("revenue").alias("v"))), "fact_vs_agg_revenue", "all", tolerance)


def run_recon(checks: list[DataFrame], run_id: str, env: str, now: str, store: Callable[[DataFrame], None], fail_on_mismatch: bool = True) -> dict[str, int]:
    """Evaluates all checks, stores them, then raises if any failed, unless it is told to report only."""
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    stamped = out.select(F.lit(run_id).alias("run_id"), F.lit(env).alias("env"), *RESULT_COLUMNS, F.lit(now).cast("timestamp_ntz").alias("checked_at"))
    rows = stamped.collect()  # one row per check and file
    store(out.sparkSession.createDataFrame(rows, stamped.schema))
    bad = [f"{r.check_name}:{r.scope}" for r in rows if not r.passed]
    if bad and fail_on_mismatch:
        raise ReconError("failed checks: " + ", ".join(bad[:50]))
    return {"checks": len(rows), "failed": len(bad)}
