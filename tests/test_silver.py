import hashlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.contract import SILVER_COLUMNS, TRIP_COLUMNS, TRIPS
from millrace.functions.hashing import surrogate_hash
from millrace.operators import silver

RAW = ("VendorID int, tpep_pickup_datetime timestamp, tpep_dropoff_datetime timestamp, passenger_count bigint, trip_distance double, RatecodeID int, store_and_fwd_flag string, "
       "PULocationID int, DOLocationID int, payment_type int, fare_amount double, extra double, mta_tax double, tip_amount double, tolls_amount double, improvement_surcharge double, "
       "total_amount double, congestion_surcharge double, Airport_fee double, _ingested_at timestamp_ntz, _source_file string")
BASE = [2, "2024-01-15 08:00:00", "2024-01-15 08:30:00", 1, 5.0, 1, "N", 100, 200, 1, 20.0, 0.0, 0.5, 4.0, 0.0, 1.0, 25.5, 2.5, 0.0, "2024-02-01 00:00:00", "f1.parquet"]
NAMES = [x.split()[0] for x in RAW.split(", ")]


def trip(**change):
    r = list(BASE)
    for k, v in change.items():
        r[NAMES.index(k)] = v
    return tuple(r)


def flags(frame, **change):
    df = silver.flag_violations(silver.standardize(frame([trip(**change)], RAW)))
    return df.first().dq_violations


def test_standardize_names_types_and_missing(frame):
    df = silver.standardize(frame([trip()], RAW).drop("Airport_fee").withColumnRenamed("trip_distance", "Trip_Distance").withColumn("unknown", F.lit(1)))
    assert df.columns == [*TRIP_COLUMNS, "_source_file", "_ingested_at"]
    assert {c: t for c, t in df.dtypes if c in TRIP_COLUMNS} == TRIP_COLUMNS
    r = df.first()
    assert r.vendor_id == 2 and r.trip_distance == 5.0 and r.airport_fee is None


def test_unreadable_values_are_null(frame):
    df = frame([trip()], RAW).withColumn("VendorID", F.lit("x1"))
    assert silver.standardize(df).first().vendor_id is None


def test_dedup_takes_latest_and_breaks_ties(frame):
    df = frame([("a", 1, "2024-01-01 00:00:00"), ("a", 2, "2024-01-02 00:00:00"), ("b", 1, "2024-01-01 00:00:00"), ("b", 3, "2024-01-01 00:00:00"), (None, 5, None), (None, 4, None)],
               "k string, v int, _ingested_at timestamp_ntz")
    assert rows(silver.latest_per_key(df, ["k"]), "k", "v") == [("a", 2), ("b", 3), (None, 5)]
    assert rows(silver.latest_per_key(df.drop("_ingested_at"), ["k"]), "k", "v") == [("a", 2), ("b", 3), (None, 5)]
    assert silver.latest_per_key(df.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("change, want", [
    ({}, []),
    ({"tpep_pickup_datetime": None}, ["null_pickup_ts"]),
    ({"tpep_dropoff_datetime": None}, ["null_dropoff_ts"]),
    ({"tpep_dropoff_datetime": "2024-01-15 07:59:59"}, ["dropoff_before_pickup"]),
    ({"tpep_dropoff_datetime": "2024-01-16 08:00:00"}, []),
    ({"tpep_dropoff_datetime": "2024-01-16 08:00:01"}, ["trip_longer_than_24h"]),
    ({"trip_distance": 0.0}, []), ({"trip_distance": 500.0}, []), ({"trip_distance": 500.1}, ["invalid_trip_distance"]), ({"trip_distance": -0.1}, ["invalid_trip_distance"]),
    ({"trip_distance": float("nan")}, ["invalid_trip_distance"]), ({"trip_distance": None}, []),
    ({"total_amount": 0.0}, ["non_positive_total_amount"]), ({"total_amount": None}, []), ({"total_amount": float("nan")}, []),
    ({"passenger_count": 0}, []), ({"passenger_count": 8}, []), ({"passenger_count": 9}, ["invalid_passenger_count"]), ({"passenger_count": None}, []),
    ({"PULocationID": None}, ["null_zone_id"]), ({"DOLocationID": None}, ["null_zone_id"]),
    ({"total_amount": -5.0, "trip_distance": 900.0}, ["invalid_trip_distance", "non_positive_total_amount"]),
])
def test_violations(frame, change, want):
    assert flags(frame, **change) == want


def test_derived_columns_and_hash(frame):
    r = silver.derive(silver.standardize(frame([trip()], RAW))).first()
    assert (r.trip_minutes, r.avg_speed_mph, r.tip_pct, r.pickup_hour, str(r.pickup_date)) == (30.0, 10.0, 20.0, 8, "2024-01-15")
    want = "2||2024-01-15 08:00:00||2024-01-15 08:30:00||100||200||25.5"
    assert r.trip_hash == hashlib.sha256(want.encode()).hexdigest()


def test_guards(frame):
    r = silver.derive(silver.standardize(frame([trip(tpep_dropoff_datetime="2024-01-15 08:00:00", fare_amount=0.0)], RAW))).first()
    assert r.trip_minutes == 0.0 and r.avg_speed_mph is None and r.tip_pct is None


def test_hash_of_nulls_and_negative_zero(frame):
    df = frame([(None, 0.0), (None, -0.0)], "a int, b double")
    a, b = (r[0] for r in df.select(surrogate_hash(df, ["a", "b"])).collect())
    assert a == b == hashlib.sha256(b"<null>||0.0").hexdigest()


def test_split_and_pipeline_order(frame):
    # a later bad row displaces an earlier good one of the same key
    later = trip(passenger_count=20, _ingested_at="2024-03-01 00:00:00")
    df = frame([trip(), later, trip(VendorID=1), trip(VendorID=7, total_amount=-1.0)], RAW)
    clean, bad = silver.split(silver.tagged(df))
    assert rows(clean, "vendor_id") == [(1,)] and rows(bad, "vendor_id") == [(2,), (7,)]
    assert "dq_violations" not in clean.columns and "dq_violations" in bad.columns
    assert silver.silver_columns(clean).columns == SILVER_COLUMNS
    assert rows(silver.quarantine_reasons(bad)) == [("invalid_passenger_count", 1), ("non_positive_total_amount", 1)]


def test_empty(frame):
    clean, bad = silver.split(silver.tagged(frame([], RAW)))
    assert clean.count() == 0 and bad.count() == 0


def test_rounding(frame):
    from millrace.functions.rounding import by_floor, half_up

    r = frame([(1.005,), (2.675,)], "x double").select(half_up(F.col("x")).alias("h"), by_floor(F.col("x")).alias("f")).collect()
    assert [x.h for x in r] == [1.01, 2.68] and [x.f for x in r] == [1.0, 2.68] or [x.f for x in r] == [1.0, 2.67]
    assert TRIPS.key[0] == "vendor_id"
