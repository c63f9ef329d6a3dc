"""Dimensions, fact and marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.contract import FACT_COLUMNS
from millrace.functions.rounding import ROUNDINGS
from millrace.functions.times import yyyymmdd
from millrace.session import bounded_broadcast

# Seed rows of the static dimensions.
VENDORS = [(1, "Creative Mobile Technologies, LLC"), (2, "Curb Mobility, LLC"), (6, "Myle Technologies Inc"), (7, "Helix")]
PAYMENT_TYPES = [(0, "Flex Fare trip"), (1, "Credit card"), (2, "Cash"), (3, "No charge"), (4, "Dispute"), (5, "Unknown"), (6, "Voided trip")]
RATE_CODES = [(1, "Standard rate"), (2, "JFK"), (3, "Newark"), (4, "Nassau or Westchester"), (5, "Negotiated fare"), (6, "Group ride"), (99, "Unknown")]
SEEDS = {"dim_vendor": (VENDORS, "vendor_id int, vendor_name string"), "dim_payment_type": (PAYMENT_TYPES, "payment_type_id int, payment_type string"),
         "dim_rate_code": (RATE_CODES, "rate_code_id int, rate_code string")}


def seed(spark: SparkSession, name: str) -> DataFrame:
    rows, ddl = SEEDS[name]
    return spark.createDataFrame(rows, ddl)


def dim_date(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day of [start, end]; none if end is before start."""
    day = F.col("date")
    days = spark.range(1).select(F.explode(F.when(F.lit(start).cast("date") <= F.lit(end).cast("date"), F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")))).alias("date"))
    dow = F.dayofweek(day)
    return days.select(
        yyyymmdd(day).alias("date_key"), day, F.year(day).alias("year"), F.quarter(day).alias("quarter"), F.month(day).alias("month"),
        F.date_format(day, "MMMM").alias("month_name"), F.dayofmonth(day).alias("day_of_month"), dow.alias("day_of_week"),
        F.date_format(day, "EEEE").alias("day_name"), F.weekofyear(day).alias("week_of_year"), dow.isin(1, 7).alias("is_weekend"))


def date_bounds(trips: DataFrame, column: str = "pickup_date") -> tuple[str, str] | None:
    """First and last day, or None for an empty table."""
    r = trips.agg(F.min(column).cast("string").alias("a"), F.max(column).cast("string").alias("b")).first()
    return (r.a, r.b) if r.a is not None else None


def build_fact(silver: DataFrame) -> DataFrame:
    return silver.withColumn("date_key", yyyymmdd("pickup_date")).select(*FACT_COLUMNS)


def money(c: str | Column) -> Column:
    """A sum of money that does not depend on the order of rows; null for no rows."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(F.when(~F.isnan(c), c).cast("decimal(18,2)")).cast("double")


def mean(c: str, digits: int = 4) -> Column:
    """A mean that does not depend on the order of rows: sums are taken in decimals; NaN counts as no value."""
    x = F.when(~F.isnan(c), F.col(c))
    return F.sum(x.cast(f"decimal(18,{digits})")).cast("double") / F.count(x)


def current_zones(dim_zone: DataFrame) -> DataFrame:
    """One current version per zone: of several the one that began last."""
    best = F.max_by(F.struct("borough", "zone_name"), F.struct("effective_from", "zone_key") if "zone_key" in dim_zone.columns else F.col("effective_from"))
    return dim_zone.filter("is_current").groupBy("zone_id").agg(best.alias("_z")).select("zone_id", "_z.borough", "_z.zone_name")


def mart_daily(fact: DataFrame, zones: DataFrame, rounding: str = "half_up") -> DataFrame:
    """Trips, revenue and means per day and pickup zone. Facts are aggregated before zone names are joined, so the
    names travel with a few rows per day; rides of unknown zones stay, with null names."""
    rnd = ROUNDINGS[rounding]
    per = fact.groupBy("date_key", "pickup_zone_id").agg(
        F.count("*").alias("trips"), rnd(money("total_amount")).alias("revenue"), rnd(mean("trip_distance")).alias("avg_distance"),
        rnd(mean("tip_pct")).alias("avg_tip_pct"), rnd(mean("trip_minutes")).alias("avg_trip_minutes"))
    return per.join(bounded_broadcast(zones), per.pickup_zone_id == zones.zone_id, "left").select(
        "date_key", "pickup_zone_id", "borough", "zone_name", "trips", "revenue", "avg_distance", "avg_tip_pct", "avg_trip_minutes")


def mart_monthly(fact: DataFrame, rounding: str = "half_up") -> DataFrame:
    """Key figures per month; avg_fare is the mean of the total amount."""
    rnd = ROUNDINGS[rounding]
    month = F.floor(F.col("date_key") / 100).alias("month")
    return fact.groupBy(month).agg(
        F.count("*").alias("trips"), rnd(money("total_amount")).alias("revenue"), rnd(mean("total_amount")).alias("avg_fare"),
        rnd(mean("tip_pct")).alias("avg_tip_pct"), F.countDistinct("pickup_zone_id").alias("active_pickup_zones"))
