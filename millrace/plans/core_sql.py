"""The SQL that each core query is compared with."""

from __future__ import annotations

import re

from millrace.contract import FACT_COLUMNS, TRIPS
from millrace.operators.gold import SEEDS
from millrace.plans.core import CUT, FIRST_SNAPSHOT, NEXT_SNAPSHOT, NOW, RAW_KEY
from millrace.plans.training import _HISTORY, _SEGMENT, _VALID

_SOURCE = {v: k.lower() for k, v in TRIPS.renames.items()}
_STANDARD = ", ".join(f"{_SOURCE.get(c, c)} AS {c}" for c in TRIPS.columns)
_SECONDS = "CAST(floor(epoch({e})) - floor(epoch({s})) AS BIGINT)"
_FLAG_PARTS = ", ".join(f"CASE WHEN {r.bad_when.format(seconds=_SECONDS.format(e='dropoff_ts', s='pickup_ts'))} THEN '{r.name}' END" for r in TRIPS.rules)
_FLAGGED = f"s AS (SELECT record_id, {_STANDARD}, _source_file, _ingested_at FROM yellow_trips_raw), f AS (SELECT *, concat_ws(',', {_FLAG_PARTS}) AS violations FROM s)"


def _floor(x: str) -> str:
    return f"(floor(({x}) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE)"


def _money(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(18,2))) FILTER (NOT isnan({c})) AS DOUBLE)"


def _mean(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(18,4))) FILTER (NOT isnan({c})) AS DOUBLE) / count({c}) FILTER (NOT isnan({c}))"


def _half_up(x: str) -> str:
    """Half away from zero on the decimal text of the double."""
    return f"CAST(round(CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38,20)), 2) AS DOUBLE)"


_ZONES = "z AS (SELECT zone_id, arg_max(borough, (effective_from, zone_key)) AS borough, arg_max(zone_name, (effective_from, zone_key)) AS zone_name FROM (SELECT zone_id, coalesce(borough, chr(0)) borough, coalesce(zone_name, chr(0)) zone_name, effective_from, zone_key FROM dim_zone WHERE is_current) GROUP BY zone_id)"
_DAILY = f"""{_ZONES}, g AS (SELECT date_key, pickup_zone_id, count(*) AS trips, {_floor(_money('total_amount'))} AS revenue, {_floor(_mean('trip_distance'))} AS avg_distance,
 {_floor(_mean('tip_pct'))} AS avg_tip_pct, {_floor(_mean('trip_minutes'))} AS avg_trip_minutes FROM fact_trips GROUP BY date_key, pickup_zone_id),
 daily AS (SELECT date_key, pickup_zone_id, nullif(borough, chr(0)) AS borough, nullif(zone_name, chr(0)) AS zone_name, trips, revenue, avg_distance, avg_tip_pct, avg_trip_minutes FROM g LEFT JOIN z ON g.pickup_zone_id = z.zone_id)"""
_MONTHLY = f"monthly AS (SELECT CAST(date_key // 100 AS BIGINT) AS month, count(*) AS trips, {_floor(_money('total_amount'))} AS revenue, {_floor(_mean('total_amount'))} AS avg_fare, {_floor(_mean('tip_pct'))} AS avg_tip_pct, count(DISTINCT pickup_zone_id) AS active_pickup_zones FROM fact_trips GROUP BY 1)"
_DAYS = """d AS (SELECT CAST(x AS DATE) AS date FROM (SELECT unnest(generate_series(TIMESTAMP '2023-01-01', TIMESTAMP '2024-06-30', INTERVAL 1 DAY)) AS x)),
 dates AS (SELECT CAST(strftime(date, '%Y%m%d') AS INTEGER) AS date_key, date, CAST(year(date) AS INTEGER) AS year, CAST(quarter(date) AS INTEGER) AS quarter, CAST(month(date) AS INTEGER) AS month, monthname(date) AS month_name,
 CAST(day(date) AS INTEGER) AS day_of_month, CAST(dayofweek(date) + 1 AS INTEGER) AS day_of_week, dayname(date) AS day_name, CAST(weekofyear(date) AS INTEGER) AS week_of_year, dayofweek(date) IN (0, 6) AS is_weekend FROM d)"""
_DAILY_UP, _MONTHLY_UP = (re.sub(r"\(floor\(\((.*?)\) \* 100\.0::DOUBLE \+ 0\.5::DOUBLE\) / 100\.0::DOUBLE\)", lambda m: _half_up(m.group(1)), x) for x in (_DAILY, _MONTHLY))
_ONE = "a AS (SELECT zone_id, borough, zone_name, service_zone FROM one WHERE snapshot_date = DATE '{day}')"
_FIRST = _ONE.format(day=FIRST_SNAPSHOT)
_NEXT = "b AS (SELECT zone_id, borough, zone_name, service_zone FROM one WHERE snapshot_date = DATE '" + NEXT_SNAPSHOT + "')"
_OPEN = "CAST(NULL AS TIMESTAMP) AS effective_to, true AS is_current"


def _result(name: str, table: str, kind: str, severity: str, total: str, failed: str) -> str:
    return f"SELECT '{name}' AS rule_name, '{table}' AS table_name, '{kind}' AS rule_type, '{severity}' AS severity, ({total}) AS total_rows, CAST(({failed}) AS BIGINT) AS failed_rows, ({failed}) = 0 AS passed"


def _rows(t: str) -> str:
    return f"SELECT count(*) FROM {t}"


_DQ = {
    "not_null_pickup": _result("not_null_pickup", "fact_trips", "not_null", "error", _rows("fact_trips"), "SELECT count(*) FROM fact_trips WHERE pickup_ts IS NULL"),
    "unique_hash": _result("unique_hash", "yellow_trips", "unique", "error", _rows("yellow_trips"), "SELECT count(*) FROM (SELECT trip_hash FROM yellow_trips GROUP BY trip_hash HAVING count(*) > 1)"),
    "amount_range": _result("amount_range", "yellow_trips", "range", "error", _rows("yellow_trips"), "SELECT count(*) FROM yellow_trips WHERE total_amount < 0 OR total_amount > 10000"),
    "distance_range": _result("distance_range", "yellow_trips", "range", "error", _rows("yellow_trips"), "SELECT count(*) FROM yellow_trips WHERE trip_distance < 0 OR trip_distance > 500"),
    "payment_accepted": _result("payment_accepted", "fact_trips", "accepted_values", "warn", _rows("fact_trips"), "SELECT count(*) FROM fact_trips WHERE payment_type_id NOT IN (0, 1, 2, 3, 4, 5, 6)"),
    "trips_present": _result("trips_present", "yellow_trips", "row_count_min", "error", _rows("yellow_trips"), "SELECT CASE WHEN count(*) < 1 THEN 1 ELSE 0 END FROM yellow_trips"),
    "fresh": _result("fresh", "yellow_trips_raw", "freshness", "warn", _rows("yellow_trips_raw"), f"SELECT CASE WHEN max(_ingested_at) IS NULL OR floor((epoch(TIMESTAMP '{NOW}') - floor(epoch(max(_ingested_at)))) / 86400) > 20 THEN 1 ELSE 0 END FROM yellow_trips_raw"),
    "zones_known": _result("zones_known", "fact_trips", "referential", "warn", _rows("fact_trips"), "SELECT count(*) FROM fact_trips WHERE pickup_zone_id IS NOT NULL AND pickup_zone_id NOT IN (SELECT TRY_CAST(locationid AS INTEGER) FROM taxi_zone_lookup WHERE TRY_CAST(locationid AS INTEGER) IS NOT NULL)"),
}


def _dq(*names: str) -> str:
    return " UNION ALL ".join(_DQ[n] for n in (names or _DQ))


def _recon(name: str, source: str, target: str, tolerance: float = 0.0, scope: str = "'all'", rest: str = "") -> str:
    return (f"SELECT '{name}' AS check_name, {scope} AS scope, CAST({source} AS DOUBLE) AS source_value, CAST({target} AS DOUBLE) AS target_value, "
            f"abs(CAST({source} AS DOUBLE) - CAST({target} AS DOUBLE)) AS difference, abs(CAST({source} AS DOUBLE) - CAST({target} AS DOUBLE)) <= {tolerance} AS passed {rest}")


_TOTAL = f"(SELECT {_money('total_amount')} FROM {{t}})"
_SILVER_GOLD = _recon("silver_vs_fact_rows", "(SELECT count(*) FROM yellow_trips)", "(SELECT count(*) FROM fact_trips)") + " UNION ALL " + _recon("silver_vs_fact_total_amount", _TOTAL.format(t="yellow_trips"), _TOTAL.format(t="fact_trips"), 0.01)
_ORDER = ", ".join(f"{c} DESC NULLS LAST" for c in ["_ingested_at", *TRIPS.columns, "_source_file"])
_HASH = "sha256(concat_ws('||', " + ", ".join(f"coalesce({c}, '<null>')" for c in (
    "CAST(vendor_id AS VARCHAR)", "strftime(pickup_ts, '%Y-%m-%d %H:%M:%S')", "strftime(dropoff_ts, '%Y-%m-%d %H:%M:%S')", "CAST(pickup_zone_id AS VARCHAR)", "CAST(dropoff_zone_id AS VARCHAR)", "CAST(total_amount AS VARCHAR)")) + "))"

_PIPELINE = f"""{_HISTORY}, {_FLAGGED}, k AS (SELECT *, _ingested_at >= TIMESTAMP '{CUT}' AS later, {_HASH} AS h FROM f QUALIFY row_number() OVER (PARTITION BY later, {', '.join(TRIPS.key)} ORDER BY {_ORDER}) = 1),
 held AS (SELECT * EXCLUDE later, CASE WHEN later THEN 1 ELSE 0 END AS run FROM k QUALIFY row_number() OVER (PARTITION BY h ORDER BY later) = 1)"""


def _bad(t: str, when: str) -> str:
    return f"SELECT count(*) FROM {t} WHERE {when}"


_RULE_FILE = [
    ("bronze", "rides_arrived", "yellow_trips_raw", "SELECT CAST(count(*) < 1 AS BIGINT) FROM yellow_trips_raw"),
    ("bronze", "rides_name_their_file", "yellow_trips_raw", _bad("yellow_trips_raw", "_source_file IS NULL")),
    ("bronze", "rides_carry_their_arrival", "yellow_trips_raw", _bad("yellow_trips_raw", "_ingested_at IS NULL")),
    ("bronze", "zone_lookup_complete", "taxi_zone_lookup", "SELECT CAST(count(*) < 250 AS BIGINT) FROM taxi_zone_lookup"),
    ("silver", "hash_identifies_ride", "yellow_trips", "SELECT count(*) FROM (SELECT trip_hash FROM yellow_trips GROUP BY trip_hash HAVING count(*) > 1)"),
    ("silver", "ride_begins", "yellow_trips", _bad("yellow_trips", "pickup_ts IS NULL")),
    ("silver", "ride_ends", "yellow_trips", _bad("yellow_trips", "dropoff_ts IS NULL")),
    ("silver", "distance_within_contract", "yellow_trips", _bad("yellow_trips", "trip_distance < 0 OR trip_distance > 500")),
    ("silver", "passengers_within_contract", "yellow_trips", _bad("yellow_trips", "passenger_count < 0 OR passenger_count > 8")),
    ("silver", "total_not_negative", "yellow_trips", _bad("yellow_trips", "total_amount < 0")),
    ("silver", "payment_type_seeded", "yellow_trips", _bad("yellow_trips", "payment_type_id NOT IN (0, 1, 2, 3, 4, 5, 6)")),
    ("silver", "pickup_zone_in_lookup", "yellow_trips", _bad("yellow_trips", "pickup_zone_id IS NOT NULL AND pickup_zone_id NOT IN (SELECT TRY_CAST(locationid AS INTEGER) FROM taxi_zone_lookup WHERE TRY_CAST(locationid AS INTEGER) IS NOT NULL)")),
    ("silver", "rides_not_stale", "yellow_trips", f"SELECT CAST(max(pickup_ts) IS NULL OR floor((epoch(TIMESTAMP '{NOW}') - floor(epoch(max(pickup_ts)))) / 86400) > 1200 AS BIGINT) FROM yellow_trips"),
]
ORACLE = {
    "standardize": f"SELECT {_STANDARD}, _source_file, _ingested_at FROM yellow_trips_raw",
    "dedup_latest": "SELECT record_id, " + ", ".join(f"{c} AS {n}" for c, n in zip(RAW_KEY, TRIPS.key)) + f", _ingested_at FROM yellow_trips_raw QUALIFY row_number() OVER (PARTITION BY {', '.join(RAW_KEY)} ORDER BY _ingested_at DESC NULLS LAST, record_id DESC) = 1",
    "validity_flags": f"WITH {_FLAGGED} SELECT record_id, violations FROM f",
    "split_clean": f"WITH {_FLAGGED} SELECT record_id, pickup_ts, total_amount FROM f WHERE violations = ''",
    "split_quarantine": f"WITH {_FLAGGED} SELECT record_id, pickup_ts, total_amount, violations FROM f WHERE violations <> ''",
    "quarantine_reasons": f"WITH {_FLAGGED} SELECT replace(violations, ',', ', ') AS reasons, count(*) AS n FROM f WHERE violations <> '' GROUP BY 1",
    "derived_columns": f"""WITH a AS (SELECT *, {_floor(_SECONDS.format(e='dropoff_ts', s='pickup_ts') + ' / 60.0::DOUBLE')} AS m FROM yellow_trips)
SELECT trip_id, CAST(pickup_ts AS DATE) AS pickup_date, CAST(hour(pickup_ts) AS INTEGER) AS pickup_hour, m AS trip_minutes, CASE WHEN m > 0 THEN {_floor('trip_distance / (m / 60.0::DOUBLE)')} END AS avg_speed_mph,
CASE WHEN fare_amount > 0 THEN {_floor('tip_amount / fare_amount * 100.0::DOUBLE')} END AS tip_pct FROM a""",
    "surrogate_hashes": f"SELECT trip_id, {_HASH} AS trip_hash FROM yellow_trips",
    "silver_full": f"WITH {_FLAGGED}, k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY {', '.join(TRIPS.key)} ORDER BY {_ORDER}) = 1) SELECT _source_file, count(*) AS n, count(*) FILTER (violations <> '') AS bad FROM k GROUP BY _source_file",
    "incremental_files": f"SELECT trip_id, _source_file FROM yellow_trips WHERE _source_file NOT IN (SELECT _source_file FROM yellow_trips WHERE _ingested_at < TIMESTAMP '{CUT}')",
    "merge_insert_only": f"""WITH a AS (SELECT trip_hash, trip_id FROM yellow_trips WHERE _ingested_at < TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY trip_hash ORDER BY _ingested_at DESC, trip_id DESC) = 1),
 b AS (SELECT trip_hash, trip_id FROM yellow_trips WHERE _ingested_at >= TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY trip_hash ORDER BY _ingested_at DESC, trip_id DESC) = 1)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.trip_hash = b.trip_hash)""",
    "dim_date": f"WITH {_DAYS} SELECT * FROM dates",
    "dim_static_seed": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {i}, '{t}')" for n, (rows, _) in SEEDS.items() for i, t in rows) + ") t(dim, id, name)",
    "scd2_initial": f"WITH {_HISTORY}, {_FIRST} SELECT *, TIMESTAMP '2023-01-01 00:00:00' AS effective_from, {_OPEN} FROM a",
    "scd2_change": f"""WITH {_HISTORY}, {_FIRST}, {_NEXT}, c AS (SELECT b.* FROM b LEFT JOIN a USING (zone_id) WHERE a.zone_id IS NULL OR a.borough IS DISTINCT FROM b.borough OR a.zone_name IS DISTINCT FROM b.zone_name OR a.service_zone IS DISTINCT FROM b.service_zone)
SELECT a.*, TIMESTAMP '2023-01-01 00:00:00' AS effective_from, CASE WHEN c.zone_id IS NOT NULL THEN TIMESTAMP '2024-06-01 00:00:00' END AS effective_to, c.zone_id IS NULL AS is_current FROM a LEFT JOIN c USING (zone_id)
UNION ALL SELECT *, TIMESTAMP '2024-06-01 00:00:00', NULL, true FROM c""",
    "scd2_noop": f"WITH {_HISTORY}, {_FIRST} SELECT *, TIMESTAMP '2023-01-01 00:00:00' AS effective_from, {_OPEN} FROM a",
    "scd2_as_was": f"""WITH {_SEGMENT}, {_VALID}, w AS (SELECT DISTINCT zone_key, borough FROM dim_zone)
SELECT w.borough, count(*) AS trips FROM fact_trips r LEFT JOIN v ON r.trip_id = v.trip_id AND r.pickup_ts = v.pickup_ts AND r.pickup_zone_id = v.zone_id LEFT JOIN w USING (zone_key) GROUP BY w.borough""",
    "build_fact": "SELECT " + ", ".join("CAST(strftime(pickup_date, '%Y%m%d') AS INTEGER) AS date_key" if c == "date_key" else c for c in FACT_COLUMNS) + " FROM yellow_trips",
    "mart_daily": f"WITH {_DAILY} SELECT * FROM daily",
    "mart_monthly": f"WITH {_MONTHLY} SELECT * FROM monthly",
    "bi_monthly_kpis": f"WITH {_MONTHLY} SELECT month, trips, revenue, avg_fare, avg_tip_pct FROM monthly ORDER BY month",
    "bi_top_zones": f"WITH {_DAILY}, t AS (SELECT zone_name, borough, {_money('revenue')} AS revenue, CAST(sum(trips) AS BIGINT) AS trips FROM daily GROUP BY zone_name, borough) SELECT *, {_floor('revenue / trips')} AS revenue_per_trip FROM t ORDER BY revenue DESC, zone_name NULLS LAST, borough NULLS LAST LIMIT 15",
    "bi_demand_heatmap": f"WITH {_DAYS} SELECT day_name, day_of_week, CAST(hour(pickup_ts) AS INTEGER) AS pickup_hour, count(*) AS trips FROM fact_trips JOIN dates USING (date_key) GROUP BY ALL ORDER BY day_of_week, pickup_hour",
    "bi_payment_mix": f"SELECT payment_type, count(*) AS trips, {_floor(_money('total_amount'))} AS revenue, {_floor(_mean('tip_pct'))} AS avg_tip_pct FROM fact_trips LEFT JOIN dim_payment_type USING (payment_type_id) GROUP BY payment_type ORDER BY trips DESC",
    "bi_ops_health": f"SELECT 'DQ' AS kind, rule_name AS check_name, passed, TIMESTAMP '{NOW}' AS checked_at FROM ({_dq()}) UNION ALL SELECT 'RECON', check_name, passed, TIMESTAMP '{NOW}' FROM ({_SILVER_GOLD})",
    "bi_duplicate_hashes": "SELECT trip_hash, count(*) AS n FROM yellow_trips GROUP BY trip_hash HAVING count(*) > 1",
    "bi_rows_per_file": "SELECT _source_file, count(*) AS n FROM yellow_trips_raw GROUP BY _source_file",
    "dq_not_null": _dq("not_null_pickup"),
    "dq_unique": "SELECT trip_hash, count(*) AS n FROM yellow_trips GROUP BY trip_hash HAVING count(*) > 1",
    "dq_accepted_values": _dq("payment_accepted"),
    "dq_range": _dq("amount_range", "distance_range"),
    "dq_row_count_min": _dq("trips_present"),
    "dq_freshness": _dq("fresh"),
    "dq_referential": "SELECT pickup_zone_id AS key, count(*) AS n FROM fact_trips WHERE pickup_zone_id IS NOT NULL AND pickup_zone_id NOT IN (SELECT TRY_CAST(locationid AS INTEGER) FROM taxi_zone_lookup WHERE TRY_CAST(locationid AS INTEGER) IS NOT NULL) GROUP BY 1",
    "dq_scorecard": _dq(),
    "recon_source_bronze": "WITH m AS (SELECT _source_file f, count(*) n FROM yellow_trips_raw GROUP BY 1), b AS (SELECT _source_file f, count(*) n FROM yellow_trips GROUP BY 1) " + _recon("src_vs_bronze_rows", "coalesce(m.n, 0)", "coalesce(b.n, 0)", 0, "coalesce(m.f, b.f)", "FROM m FULL JOIN b ON m.f = b.f"),
    "recon_bronze_silver": f"WITH {_FLAGGED}, k AS (SELECT *, {_HASH} AS h FROM f QUALIFY row_number() OVER (PARTITION BY {', '.join(TRIPS.key)} ORDER BY {_ORDER}) = 1) " + _recon(
        "bronze_distinct_keys_vs_silver_total", f"(SELECT count(DISTINCT {_HASH}) FROM s)", "(SELECT count(DISTINCT h) FROM k)") + " UNION ALL " + _recon(
        "clean_and_quarantined_keys", "(SELECT count(DISTINCT h) FROM k WHERE violations = '' AND h IN (SELECT h FROM k WHERE violations <> ''))", "0"),
    "recon_silver_gold": _SILVER_GOLD,
    "recon_fact_mart": f"WITH {_DAILY} " + _recon("fact_vs_agg_revenue", _TOTAL.format(t="fact_trips"), f"(SELECT {_money('revenue')} FROM daily)", 1.0),
    "ingest_file_stream": "SELECT * EXCLUDE (meter_id, trip_distance, _source_file, _ingested_at) FROM yellow_trips",
    "ingest_schema_rescue": f"SELECT trip_id, CASE WHEN e THEN meter_id END AS meter_id, CASE WHEN e THEN trip_distance END AS trip_distance, CASE WHEN NOT e THEN meter_id END AS rescued_meter, CASE WHEN NOT e THEN CAST(trip_distance AS VARCHAR) END AS rescued_distance, CASE WHEN NOT e THEN 'north' END AS rescued_fleet FROM (SELECT *, _ingested_at < TIMESTAMP '{CUT}' AS e FROM yellow_trips)",
    "ingest_lineage": "SELECT trip_id, _source_file AS file FROM yellow_trips",
    "ingest_csv_snapshot": "SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date, " + ", ".join(f"nullif({c}, '') AS {c}" for c in ("locationid", "borough", "zone_name", "service_zone")) + " FROM taxi_zone_lookup",
    "derived_half_up": f"""WITH a AS (SELECT *, {_half_up(_SECONDS.format(e='dropoff_ts', s='pickup_ts') + ' / 60.0::DOUBLE')} AS m FROM yellow_trips)
SELECT trip_id, m AS trip_minutes, CASE WHEN m > 0 THEN {_half_up('trip_distance / (m / 60.0::DOUBLE)')} END AS avg_speed_mph, CASE WHEN fare_amount > 0 THEN {_half_up('tip_amount / fare_amount * 100.0::DOUBLE')} END AS tip_pct FROM a""",
    "mart_daily_half_up": f"WITH {_DAILY_UP} SELECT * FROM daily",
    "mart_monthly_half_up": f"WITH {_MONTHLY_UP} SELECT * FROM monthly",
    "scd2_all_snapshots": f"""WITH {_HISTORY}, s AS (SELECT o.*, lag(zone_id) OVER w IS NOT NULL AND lag(borough) OVER w IS NOT DISTINCT FROM borough AND lag(zone_name) OVER w IS NOT DISTINCT FROM zone_name
 AND lag(service_zone) OVER w IS NOT DISTINCT FROM service_zone AS same FROM o WINDOW w AS (PARTITION BY zone_id ORDER BY no)), v AS (SELECT *, lead(snapshot_date) OVER (PARTITION BY zone_id ORDER BY no) AS next FROM s WHERE NOT same)
SELECT zone_id, borough, zone_name, service_zone, CAST(snapshot_date AS TIMESTAMP) AS effective_from, CAST(next AS TIMESTAMP) AS effective_to, next IS NULL AS is_current FROM v""",
    "recon_from_landing": _recon("src_vs_bronze_rows", "n", "n", 0, "f", "FROM (SELECT regexp_replace(_source_file, '\\.parquet$', '-0.parquet') AS f, count(*) AS n FROM yellow_trips GROUP BY 1)"),
    "store_history": f"""WITH e AS (SELECT trip_hash, max(trip_id) AS trip_id FROM (SELECT * FROM yellow_trips WHERE _ingested_at < TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY trip_hash ORDER BY _ingested_at DESC, trip_id DESC) = 1) GROUP BY 1),
 l AS (SELECT trip_hash, trip_id FROM yellow_trips WHERE _ingested_at >= TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY trip_hash ORDER BY _ingested_at DESC, trip_id DESC) = 1),
 m AS (SELECT * FROM e UNION ALL SELECT * FROM l WHERE trip_hash NOT IN (SELECT trip_hash FROM e)), a AS (SELECT trip_id FROM m UNION ALL SELECT trip_id FROM yellow_trips WHERE _ingested_at < TIMESTAMP '{CUT}')
""" + " UNION ALL ".join(f"SELECT '{state}' AS state, count(*) AS n, CAST(sum(trip_id) AS BIGINT) AS ids FROM {t}" for state, t in (
        ("written", "yellow_trips"), ("replaced", "e"), ("merged", "m"), ("appended", "a"), ("compacted", "a"), ("restored", "yellow_trips"), ("vacuumed", "yellow_trips"))),
    "pipeline_tables": f"""WITH {_PIPELINE} SELECT 'silver.yellow_trips' AS name, count(*) AS n, {_money('total_amount')} AS total FROM held WHERE violations = '' UNION ALL SELECT 'silver.yellow_trips_quarantine', count(*), {_money('total_amount')} FROM held WHERE violations <> ''
 UNION ALL SELECT 'gold.fact_trips', count(*), {_money('total_amount')} FROM held WHERE violations = '' UNION ALL SELECT 'gold.agg_daily_zone_revenue', count(*), NULL FROM (SELECT DISTINCT CAST(pickup_ts AS DATE), pickup_zone_id FROM held WHERE violations = '')
 UNION ALL SELECT 'gold.dim_date', max(CAST(pickup_ts AS DATE)) - min(CAST(pickup_ts AS DATE)) + 1, NULL FROM held WHERE violations = '' UNION ALL SELECT 'gold.dim_zone', count(*), NULL FROM (SELECT * FROM o WHERE no = (SELECT max(no) FROM o))""",
    "pipeline_fact": f"WITH {_PIPELINE} SELECT h AS trip_hash, CAST(strftime(pickup_ts, '%Y%m%d') AS INTEGER) AS date_key, pickup_zone_id, total_amount FROM held WHERE violations = ''",
    "pipeline_recon": f"""WITH {_PIPELINE}, both_ AS (SELECT 'run0' AS run_id, * FROM held WHERE run = 0 UNION ALL SELECT 'run1', * FROM held),
 keys AS (SELECT 'run0' AS run_id, count(DISTINCT {_HASH}) AS n FROM s WHERE _ingested_at < TIMESTAMP '{CUT}' UNION ALL SELECT 'run1', count(DISTINCT {_HASH}) FROM s),
 t AS (SELECT run_id, count(*) AS every, count(*) FILTER (violations = '') AS clean, CAST(sum(CAST(total_amount AS DECIMAL(18,2))) FILTER (violations = '') AS DOUBLE) AS total FROM both_ GROUP BY 1)
SELECT run_id, unnest(['bronze_distinct_keys_vs_silver_total', 'clean_and_quarantined_keys', 'silver_vs_fact_rows', 'silver_vs_fact_total_amount', 'fact_vs_agg_revenue']) AS check_name, unnest([n, 0, clean, total, total]::DOUBLE[]) AS source_value, unnest([every, 0, clean, total, total]::DOUBLE[]) AS target_value, true AS passed FROM keys JOIN t USING (run_id)""",
    "pipeline_audit": "SELECT run_id, task_name, status, CAST(1 AS BIGINT) AS n FROM (SELECT unnest(['run0', 'run1']) AS run_id), (SELECT unnest(['silver_transform', 'gold_dimensions', 'gold_fact', 'gold_aggregates', 'reconciliation']) AS task_name), (SELECT unnest(['RUNNING', 'SUCCESS']) AS status)",
    "dq_rule_file": " UNION ALL ".join(f"SELECT '{layer}' AS layer, '{name}' AS rule_name, (SELECT count(*) FROM {t}) AS total_rows, ({bad}) AS failed_rows, ({bad}) = 0 AS passed" for layer, name, t, bad in _RULE_FILE),
}
