"""The physical plans that the operators are meant to have."""

import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import gold, silver
from millrace.operators.asof import AsOf, Versions
from millrace.quality.rules import DQRule, Evaluator
from millrace.store import Store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"(?<!Broadcast)\bExchange (hash|range|single|round)", plan(df), re.I))


@pytest.fixture(scope="module")
def trips(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "trips")
    (spark.range(5000).select(
        F.col("id").alias("trip_id"), (F.col("id") % 7).cast("int").alias("k"), F.timestamp_seconds(F.col("id") * 3600 + 1672531200).cast("timestamp_ntz").alias("at"),
        F.concat(F.lit("f"), F.floor(F.col("id") / 1000)).alias("_source_file"), (F.col("id") * 0.5).alias("total_amount"), F.lit("wide").alias("unused"))
     .write.parquet(path))
    return spark.read.parquet(path)


def test_asof_join_shuffles_no_event(frame, trips):
    versions = frame([(i, i % 7, f"2023-0{1 + i // 7}-01 00:00:00", None) for i in range(14)], "v int, k int, s timestamp_ntz, e timestamp_ntz")
    asof = AsOf(versions, Versions("k", "s", "e", "v"), ["v"])
    hit = asof.matched(trips.select("trip_id", "k", "at"), "k", "at")
    assert shuffles(hit) == 0 and "BroadcastHashJoin" in plan(hit) and "NestedLoop" not in plan(hit)
    assert "unused" not in plan(hit)


def test_dedup_combines_before_it_shuffles(trips):
    p = plan(silver.latest_per_key(trips.select("k", "trip_id", "at"), ["k"], "at"))
    assert "partial_max_by" in p and "Window" not in p


def test_mart_aggregates_before_it_joins(frame):
    fact = frame([(20240101, 1, 5.0, 1.0, 1.0, 1.0)], "date_key int, pickup_zone_id int, total_amount double, tip_pct double, trip_distance double, trip_minutes double")
    p = plan(gold.mart_daily(fact, frame([(1, "B", "Z")], "zone_id int, borough string, zone_name string")))
    assert p.index("BroadcastHashJoin") < p.index("HashAggregate")  # the join stands above the aggregation


def test_new_files_are_pushed_into_the_scan(spark, trips, tmp_path):
    store = Store(spark, str(tmp_path))
    store.overwrite("bronze.t", trips)
    p = plan(store.read("bronze.t").filter(F.col("_source_file").isin("f1", "f2")).select("trip_id"))
    assert "PushedFilters: [In(_source_file, [f1,f2])]" in p and "total_amount" not in p


def test_rules_of_a_table_share_one_job(spark, trips):
    seen = []
    ev = Evaluator(spark, lambda n: seen.append(n) or trips, "2024-01-01 00:00:00")
    rules = [DQRule("a", "t", "not_null", column="k"), DQRule("b", "t", "range", column="total_amount", min=0), DQRule("c", "t", "row_count_min", threshold=1),
             DQRule("d", "t", "freshness", column="at", max_age_days=9), DQRule("e", "t", "accepted_values", column="k", values=(1, 2))]
    before = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("rules", "rules")
    out = ev.evaluate(rules)
    jobs = before.getJobIdsForGroup("rules")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert seen == ["t"] and len(out) == 5 and len(jobs) <= 2  # AQE runs the aggregation's two stages as one or two jobs


def test_count_reads_no_column(trips):
    assert "ReadSchema: struct<>" in plan(trips.agg(F.count("*")))
