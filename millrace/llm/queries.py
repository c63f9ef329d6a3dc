"""Queries of the training-data problems p4, p7, p8, p9 and p10, each over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.linkage import Linker, canonical_meter
from millrace.llm.mixing import Mixer
from millrace.llm.packing import MOST_CAPACITIES, fill, pack
from millrace.llm.percentiles import Percentiles
from millrace.llm.textquality import scored
from millrace.session import table


def p4_day_states(spark: SparkSession, d: str) -> DataFrame:
    """The mergeable states of single days: counts per zone, column and cell of 0.01."""
    return Percentiles(["pickup_zone_id"], MEASURES, PROBABILITIES).state(table(spark, d, "fact_trips"), "date_key")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """All files in order of arrival through the incremental linker; every pair of deliveries of one ride."""
    pairs = Linker(spark).replay(table(spark, d, "yellow_trips")).pairs()
    return pairs.select(F.col("a").alias("trip_id_a"), F.col("b").alias("trip_id_b"))


def p7_representatives(spark: SparkSession, d: str) -> DataFrame:
    clusters = Linker(spark).replay(table(spark, d, "yellow_trips")).clusters()
    return clusters.select(F.col("id").alias("trip_id"), F.col("rep").alias("representative_id"))


def p7_same_hash(spark: SparkSession, d: str) -> DataFrame:
    """The linked pairs that SQL can tell too: one trip hash, and one meter however it is written."""
    rows = table(spark, d, "yellow_trips").select("trip_id", "trip_hash", canonical_meter("meter_id").alias("meter"))
    a, b = (rows.select(F.col("trip_id").alias(f"trip_id_{x}"), F.col("trip_hash").alias(f"h{x}"), F.col("meter").alias(f"m{x}")) for x in "ab")
    return p7_found(spark, d).join(a, "trip_id_a").join(b, "trip_id_b").filter("ha = hb AND ma = mb").select("trip_id_a", "trip_id_b")


PROBABILITIES = [0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
MEASURES = ["fare_amount", "trip_minutes", "tip_pct"]


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = Percentiles(["pickup_zone_id"], MEASURES, PROBABILITIES)
    return p.resolve(p.state(table(spark, d, "fact_trips")))


def p4_monthly_medians(spark: SparkSession, d: str) -> DataFrame:
    """States of single days, merged to months."""
    p = Percentiles(["month"], MEASURES, [0.5])
    month = F.floor(F.col("date_key") / 100).cast("int")
    days = p.state(table(spark, d, "fact_trips").withColumn("month", month), "date_key")
    return p.resolve(p.merge(days.drop("date_key")))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"), table(spark, d, "pack_capacities"))


def p8_placed(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity the documents that stand in it, with the gaps in their numbered pieces and the pieces above the capacity (none)."""
    capacities = table(spark, d, "pack_capacities")
    whole = pack(table(spark, d, "documents"), capacities).join(F.broadcast(capacities.limit(MOST_CAPACITIES)), "capacity_id").groupBy("capacity_id", "doc_id").agg(
        (F.max("piece") + 1 - F.count("*")).alias("gaps"), F.count_if(F.col("tokens") > F.col("capacity_tokens")).alias("too_large"))
    return whole.select("capacity_id", "doc_id", "gaps", "too_large")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    capacities = table(spark, d, "pack_capacities")
    return fill(pack(table(spark, d, "documents"), capacities), capacities)


def p9_sample(spark: SparkSession, d: str) -> DataFrame:
    return Mixer(table(spark, d, "documents"), table(spark, d, "mix_targets")).sample()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    m = Mixer(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return m.shares(m.sample())


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return scored(table(spark, d, "documents")).filter("not_prose >= 0.5").select("doc_id").distinct()


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return scored(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p4_percentiles, p4_monthly_medians, p4_day_states, p7_found, p7_representatives, p7_same_hash, p8_packed, p8_placed, p8_fill, p9_sample, p9_shares, p10_found, p10_statistics)}

_RANKED = """v AS (SELECT {g}, unnest(['fare_amount', 'trip_minutes', 'tip_pct']) AS "column", unnest([fare_amount, trip_minutes, tip_pct]) AS v FROM fact_trips),
 r AS (SELECT {k}, "column", v, row_number() OVER w AS rn, count(*) OVER (PARTITION BY {k}, "column") AS n FROM v WHERE v IS NOT NULL AND NOT isnan(v) WINDOW w AS (PARTITION BY {k}, "column" ORDER BY v)),
 p AS (SELECT unnest([{p}]::DOUBLE[]) AS probability)
SELECT {k}, "column", probability, CAST(round(v * 100) AS BIGINT) / 100.0::DOUBLE AS value, n, 0.005::DOUBLE AS error_bound FROM r JOIN p ON rn = greatest(1, CAST(ceil(probability * n) AS BIGINT))"""
_METER = "nullif(regexp_replace(regexp_replace(upper(trim(meter_id)), '[^A-Z0-9]+', '-', 'g'), '-0+([0-9])', '-\\1', 'g'), '')"
ORACLE: dict[str, str] = {
    "p7_same_hash": f"""WITH r AS (SELECT trip_id, trip_hash, _source_file, {_METER} AS meter FROM yellow_trips)
SELECT a.trip_id AS trip_id_a, b.trip_id AS trip_id_b FROM r a JOIN r b ON a.trip_hash = b.trip_hash AND a.meter = b.meter AND a.trip_id < b.trip_id AND a._source_file <> b._source_file""",
    "p8_placed": "SELECT capacity_id, doc_id, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS too_large FROM documents, pack_capacities",
    "p4_percentiles": "WITH " + _RANKED.format(g="pickup_zone_id", k="pickup_zone_id", p=", ".join(map(str, PROBABILITIES))),
    "p4_day_states": """WITH v AS (SELECT pickup_zone_id, date_key, unnest(['fare_amount', 'trip_minutes', 'tip_pct']) AS "column", unnest([fare_amount, trip_minutes, tip_pct]) AS v FROM fact_trips)
SELECT pickup_zone_id, date_key, "column", CAST(round(v * 100) AS BIGINT) AS cell, count(*) AS n FROM v WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY ALL""",
    "p4_monthly_medians": "WITH " + _RANKED.format(g="CAST(date_key // 100 AS INTEGER) AS month", k="month", p="0.5"),
}
