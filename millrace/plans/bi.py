"""The five dashboard queries, as functions of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.rounding import ROUNDINGS
from millrace.operators.gold import money
from millrace.session import bounded_broadcast


def monthly_kpis(monthly: DataFrame) -> DataFrame:
    return monthly.select("month", "trips", "revenue", "avg_fare", "avg_tip_pct").orderBy("month")


def top_zones(daily: DataFrame, k: int = 15, rounding: str = "half_up") -> DataFrame:
    """The k zones of most revenue; ties by name. Revenue per trip is weighted over days."""
    rnd = ROUNDINGS[rounding]
    per = daily.groupBy("zone_name", "borough").agg(money("revenue").alias("revenue"), F.sum("trips").alias("trips"))
    per = per.withColumn("revenue_per_trip", rnd(F.col("revenue") / F.col("trips")))
    return per.orderBy(F.desc("revenue"), F.asc_nulls_last("zone_name"), F.asc_nulls_last("borough")).limit(k)


def demand_heatmap(fact: DataFrame, dates: DataFrame) -> DataFrame:
    per = fact.groupBy("date_key", F.hour("pickup_ts").alias("pickup_hour")).agg(F.count("*").alias("n"))
    return per.join(bounded_broadcast(dates.select("date_key", "day_name", "day_of_week")), "date_key").groupBy("day_name", "day_of_week", "pickup_hour").agg(
        F.sum("n").alias("trips")).orderBy("day_of_week", "pickup_hour")


def payment_mix(fact: DataFrame, payment_types: DataFrame, rounding: str = "half_up") -> DataFrame:
    """Sums per id are taken before names are joined; ids of one name, and unknown ids, are added up."""
    rnd = ROUNDINGS[rounding]
    tip = F.when(~F.isnan("tip_pct"), F.col("tip_pct"))
    per = fact.groupBy("payment_type_id").agg(F.count("*").alias("n"), F.sum(F.when(~F.isnan("total_amount"), F.col("total_amount")).cast("decimal(18,2)")).alias("r"),
                                             F.sum(tip.cast("decimal(18,4)")).alias("t"), F.count(tip).alias("tn"))
    return per.join(bounded_broadcast(payment_types.select("payment_type_id", "payment_type")), "payment_type_id", "left").groupBy("payment_type").agg(
        F.sum("n").alias("trips"), rnd(F.sum("r").cast("double")).alias("revenue"),
        rnd(F.when(F.sum("tn") > 0, F.sum("t").cast("double") / F.sum("tn"))).alias("avg_tip_pct")).orderBy(F.desc("trips"))


def ops_health(dq_results: DataFrame, recon_results: DataFrame, now: str, days: int = 35) -> DataFrame:
    """DQ and reconciliation checks of the last days, newest first."""
    since = F.date_sub(F.lit(now).cast("date"), days).cast("timestamp_ntz")
    dq = dq_results.select(F.lit("DQ").alias("kind"), F.col("rule_name").alias("check_name"), "passed", "checked_at")
    recon = recon_results.select(F.lit("RECON").alias("kind"), "check_name", "passed", "checked_at")
    return dq.unionByName(recon).filter(F.col("checked_at") >= since).orderBy(F.desc("checked_at"), "kind", "check_name")


def failed_runs(runs: DataFrame) -> DataFrame:
    return runs.filter("status = 'FAILED'").orderBy(F.desc("logged_at"))


def failed_rules(dq_results: DataFrame) -> DataFrame:
    return dq_results.filter("NOT passed").orderBy(F.desc("checked_at"))


def failed_recon(recon_results: DataFrame) -> DataFrame:
    return recon_results.filter("NOT passed").orderBy(F.desc("checked_at"))


def duplicate_hashes(trips: DataFrame, key: str = "trip_hash") -> DataFrame:
    return trips.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def rows_per_file(rows: DataFrame, file: str = "_source_file") -> DataFrame:
    return rows.groupBy(file).agg(F.count("*").alias("n"))


