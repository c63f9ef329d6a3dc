"""Merge, SCD2, dimensions, fact, marts and BI."""

import pytest
from conftest import rows

from millrace.operators import gold, merge
from millrace.operators.scd2 import scd2_apply, scd2_initial
from millrace.plans import bi

ZONE = "zone_id int, borough string, zone_name string"
TRACKED = ["borough", "zone_name"]


def test_merge_inserts_only_new_keys(frame):
    target, stage = frame([("a", 1), (None, 2)], "k string, v int"), frame([("a", 9), ("b", 8), (None, 7)], "k string, v int")
    assert rows(merge.merge_insert(target, stage, ["k"])) == sorted([("a", 1), ("b", 8), (None, 2)], key=repr)
    again = merge.merge_insert(merge.merge_insert(target, stage, ["k"]), stage, ["k"])
    assert again.count() == 3
    with pytest.raises(merge.DuplicateKeys):
        merge.merge_insert(target, stage.unionByName(stage), ["k"])
    assert merge.merge_insert(target.limit(0), stage.limit(0), ["k"]).count() == 0


def test_unprocessed_files(frame):
    data = frame([(1, "f1"), (2, "f2"), (3, None)], "id int, _source_file string")
    assert rows(merge.unprocessed(data, merge.processed_files(frame([("f1",), ("f1",)], "_source_file string"))), "id") == [(2,), (3,)]


def test_scd2_initial_change_noop(frame):
    first = scd2_initial(frame([(1, "a", "x"), (2, "b", "y"), (None, "z", "z")], ZONE), "zone_id", TRACKED, "2024-01-01 00:00:00")
    assert rows(first, "zone_id", "is_current", "effective_from") == [(1, True, "2024-01-01 00:00:00"), (2, True, "2024-01-01 00:00:00")]
    same = scd2_apply(first, frame([(1, "a", "x"), (2, "b", "y")], ZONE), "zone_id", TRACKED, "2024-02-01 00:00:00")
    assert same.counts() == {"inserted": 0, "expired": 0} and rows(same.dimension) == rows(first)
    new = scd2_apply(first, frame([(1, "a", "x2"), (3, "c", "w")], ZONE), "zone_id", TRACKED, "2024-02-01 00:00:00")
    assert new.counts() == {"inserted": 2, "expired": 1}
    got = rows(new.dimension.selectExpr("zone_id", "zone_name", "string(effective_from) f", "coalesce(string(effective_to), '') t", "is_current"))
    assert got == [(1, "x", "2024-01-01 00:00:00", "2024-02-01 00:00:00", False), (1, "x2", "2024-02-01 00:00:00", "", True), (2, "y", "2024-01-01 00:00:00", "", True), (3, "w", "2024-02-01 00:00:00", "", True)]


def test_scd2_sees_a_null_that_moves(frame):
    ddl = "zone_id int, a string, b string, c string"
    first = scd2_initial(frame([(1, "a", None, "b")], ddl), "zone_id", ["a", "b", "c"], "2024-01-01 00:00:00")
    assert scd2_apply(first, frame([(1, "a", "b", None)], ddl), "zone_id", ["a", "b", "c"], "2024-02-01 00:00:00").counts() == {"inserted": 1, "expired": 1}


def test_scd2_refuses_repeated_keys_and_starts_from_nothing(frame):
    twice = frame([(1, "a", "x"), (1, "b", "y")], ZONE)
    with pytest.raises(merge.DuplicateKeys):
        scd2_apply(None, twice, "zone_id", TRACKED, "2024-01-01 00:00:00")
    assert scd2_apply(None, twice.limit(1), "zone_id", TRACKED, "2024-01-01 00:00:00").counts() == {"inserted": 1, "expired": 0}


def test_scd2_invariants(frame):
    import random

    rng, dim = random.Random(4), None
    for m in range(1, 7):
        source = frame([(k, rng.choice(["a", "b", None]), rng.choice(["x", None])) for k in rng.sample(range(8), 6)], ZONE)
        dim = scd2_apply(dim, source, "zone_id", TRACKED, f"2024-0{m}-01 00:00:00").dimension
        dim = frame([tuple(str(v) if hasattr(v, "isoformat") else v for v in r) for r in dim.collect()], "zone_id int, borough string, zone_name string, effective_from timestamp_ntz, effective_to timestamp_ntz, is_current boolean")
    by = {}
    for r in dim.orderBy("zone_id", "effective_from").collect():
        by.setdefault(r.zone_id, []).append(r)
    for own in by.values():
        assert sum(r.is_current for r in own) == 1 and own[-1].is_current
        assert all(a.effective_to == b.effective_from for a, b in zip(own, own[1:])) and own[-1].effective_to is None


def test_dim_date(spark):
    d = gold.dim_date(spark, "2024-01-01", "2024-01-31")
    assert d.count() == 31
    r = d.filter("date_key = 20240107").first()
    assert (r.day_name, r.day_of_week, r.is_weekend, r.week_of_year, r.month_name, r.quarter) == ("Sunday", 1, True, 1, "January", 1)
    assert gold.dim_date(spark, "2024-02-01", "2024-01-01").count() == 0


def test_bounds_and_seeds(spark, frame):
    assert gold.date_bounds(frame([("2024-01-05",), ("2024-01-02",), (None,)], "pickup_date date")) == ("2024-01-02", "2024-01-05")
    assert gold.date_bounds(frame([], "pickup_date date")) is None
    assert [gold.seed(spark, n).count() for n in gold.SEEDS] == [4, 7, 7]


FACT = "date_key int, pickup_ts timestamp_ntz, pickup_zone_id int, payment_type_id int, total_amount double, tip_pct double, trip_distance double, trip_minutes double"
DATA = [(20240101, "2024-01-01 08:00:00", 1, 1, 10.0, 20.0, 1.0, 10.0), (20240101, "2024-01-01 09:00:00", 1, 2, 20.0, None, 3.0, 20.0), (20240102, "2024-01-02 08:00:00", 9, 5, 5.0, float("nan"), 2.0, 5.0),
        (None, None, None, None, 1.0, None, None, None)]


def test_marts(frame):
    zones = gold.current_zones(frame([(1, "old", "o", "2023-01-01 00:00:00", False), (1, "B", "Z", "2023-02-01 00:00:00", True), (1, "B0", "Z0", "2023-01-15 00:00:00", True)],
                                     "zone_id int, borough string, zone_name string, effective_from timestamp_ntz, is_current boolean"))
    daily = gold.mart_daily(frame(DATA, FACT), zones)
    assert rows(daily, "date_key", "pickup_zone_id", "zone_name", "trips", "revenue", "avg_distance", "avg_tip_pct", "avg_trip_minutes") == sorted(
        [(20240101, 1, "Z", 2, 30.0, 2.0, 20.0, 15.0), (20240102, 9, None, 1, 5.0, 2.0, None, 5.0), (None, None, None, 1, 1.0, None, None, None)], key=repr)
    monthly = gold.mart_monthly(frame(DATA, FACT))
    assert rows(monthly.filter("month is not null")) == [(202401, 3, 35.0, 11.67, 20.0, 2)]
    assert gold.mart_daily(frame([], FACT), zones).count() == 0


def test_bi(spark, frame):
    fact = frame(DATA, FACT)
    dates = gold.dim_date(spark, "2024-01-01", "2024-01-31")
    assert [tuple(r) for r in bi.demand_heatmap(fact, dates).collect()] == [("Monday", 2, 8, 1), ("Monday", 2, 9, 1), ("Tuesday", 3, 8, 1)]
    mix = bi.payment_mix(fact, frame([(1, "Card"), (2, "Cash")], "payment_type_id int, payment_type string"))
    assert sorted((tuple(r) for r in mix.collect()), key=repr) == sorted([(None, 2, 6.0, None), ("Card", 1, 10.0, 20.0), ("Cash", 1, 20.0, None)], key=repr)
    daily = frame([("Z", "B", 10.0, 2), ("Z", "B", 5.0, 1), ("Y", "B", 15.0, 5), (None, None, 1.0, 1)], "zone_name string, borough string, revenue double, trips bigint")
    assert [tuple(r) for r in bi.top_zones(daily, 2).collect()] == [("Y", "B", 15.0, 5, 3.0), ("Z", "B", 15.0, 3, 5.0)]
    dq = frame([("r1", True, "2024-03-01 00:00:00"), ("r2", False, "2024-01-01 00:00:00")], "rule_name string, passed boolean, checked_at timestamp_ntz")
    rc = frame([("c1", True, "2024-03-02 00:00:00")], "check_name string, passed boolean, checked_at timestamp_ntz")
    assert [r.check_name for r in bi.ops_health(dq, rc, "2024-03-10").collect()] == ["c1", "r1"]
    assert bi.failed_rules(dq).count() == 1 and bi.failed_recon(rc).count() == 0
