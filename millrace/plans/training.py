"""Queries of the general training-data problems (p1, p2, p3, p5, p6), each over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.times import yyyymmdd
from millrace.operators import spikes
from millrace.operators.asof import AsOf, Versions
from millrace.operators.drift import LandedTable
from millrace.operators.history import Snapshots, latest_per_snapshot
from millrace.operators.orphans import OrphanFinder, Reference
from millrace.operators.spikes import Reading, SpikeDetector
from millrace.session import table

ZONE = Versions("zone_id", "effective_from", "effective_to", "zone_key")
ZONE_ATTRIBUTES = ["borough", "zone_name", "service_zone"]

#: What a cab can measure at all: miles, minutes of a day, dollars, miles an hour.
READINGS = [
    Reading("trip_distance", 0.0, 1000.0),
    Reading("trip_minutes", 0.0, 1440.0),
    Reading("fare_amount", 0.0, 20000.0),
    Reading("avg_speed_mph", 0.0, 130.0),
]


def zones(spark: SparkSession, d: str) -> AsOf:
    return AsOf(table(spark, d, "dim_zone"), ZONE, ZONE_ATTRIBUTES)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    asof = zones(spark, d)
    rides = table(spark, d, "fact_trips").select("trip_id", "pickup_ts", "pickup_zone_id")
    # only segments whose version is not the newest can hold a case, so rides meet no other node
    stale = asof.segments(True).join(asof.newest(), "_k").filter("_v <> _newest").drop("_newest")
    hit = asof.matched(rides, "pickup_zone_id", "pickup_ts", stale)
    return hit.select("trip_id", F.col("_v").alias("zone_key")).distinct()


def p1_enriched(spark: SparkSession, d: str) -> DataFrame:
    rides = table(spark, d, "fact_trips").select("trip_id", "pickup_ts", "pickup_zone_id")
    return zones(spark, d).enrich(rides, "pickup_zone_id", "pickup_ts")


def orphan_finder(spark: SparkSession, d: str) -> OrphanFinder:
    dims = [("vendor_id", "dim_vendor"), ("payment_type_id", "dim_payment_type"), ("rate_code_id", "dim_rate_code")]
    refs = [Reference("pickup_zone_id", table(spark, d, "dim_zone"), "zone_id", "effective_from", "effective_to")]
    refs += [Reference(f, table(spark, d, t), f, "created_at", "deleted_at") for f, t in dims]
    return OrphanFinder(table(spark, d, "fact_trips"), "trip_id", "pickup_ts", refs)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_finder(spark, d).found().select(F.col("row_id").alias("trip_id"), "ref_field", "orphan_kind")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_finder(spark, d).counts()


BLANKS = " \t\n\u000b\f\r\u00a0"


def trimmed(c: Column) -> Column:
    """Without outer blanks; empty text is null."""
    return F.nullif(F.btrim(c, F.lit(BLANKS)), F.lit(""))


def zone_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the zone file with their ids as numbers."""
    plain, freed = F.col("locationid"), F.translate("locationid", BLANKS, "")
    digits = r"^\d+$"
    number = F.when(plain.rlike(digits), plain.try_cast("int")).when(freed.rlike(digits), freed.try_cast("int"))
    return table(spark, d, "taxi_zone_lookup").withColumn("zone_id", number)


def zone_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """One row per zone and snapshot, ids as numbers, attributes trimmed and empty text null."""
    rows = zone_rows(spark, d).withColumns({c: trimmed(F.col(c)) for c in ZONE_ATTRIBUTES})
    return latest_per_snapshot(rows, "snapshot_date", "zone_id", ZONE_ATTRIBUTES, "_ingested_at")


def compared(spark: SparkSession, d: str) -> Snapshots:
    return Snapshots(zone_rows(spark, d), "snapshot_date", "zone_id", ZONE_ATTRIBUTES, "_ingested_at", trimmed)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    h = compared(spark, d).history()
    return h.select("zone_id", yyyymmdd("valid_from").alias("valid_from_day"), F.coalesce(yyyymmdd("valid_to"), F.lit(99991231)).alias("valid_to_day"))


def p3_history(spark: SparkSession, d: str) -> DataFrame:
    return compared(spark, d).history()


def p3_changes(spark: SparkSession, d: str) -> DataFrame:
    return compared(spark, d).changes().select("zone_id", "snapshot_date", "change")


def detector() -> SpikeDetector:
    return SpikeDetector("meter_id", "pickup_ts", "trip_id", READINGS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return detector().flags(table(spark, d, "yellow_trips")).select("trip_id").distinct()


def p5_flags(spark: SparkSession, d: str) -> DataFrame:
    return detector().flags(table(spark, d, "yellow_trips"))


def p5_impossible(spark: SparkSession, d: str) -> DataFrame:
    return p5_flags(spark, d).filter("reason = 'impossible'").select("trip_id", "reading")


def p5_stuck(spark: SparkSession, d: str) -> DataFrame:
    return p5_flags(spark, d).filter("reason = 'stuck'").select("trip_id", "reading")


def landed(spark: SparkSession, d: str) -> LandedTable:
    return LandedTable(table(spark, d, "yellow_trips_raw"), "_source_file", "_ingested_at", "_rescued_data")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = [(f, c, k) for f, c, k, _, _ in landed(spark, d).changes()]
    return spark.createDataFrame(rows, "source_file string, field_name string, change_kind string").distinct()


def p6_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Values per file, field and kind: mixed kinds in one file show here."""
    return landed(spark, d).kinds()


def p6_unified(spark: SparkSession, d: str) -> DataFrame:
    return landed(spark, d).unified()


QUERIES = {f.__name__: f for f in (p1_found, p1_enriched, p2_found, p2_counts, p3_found, p3_history, p3_changes,
                                   p5_found, p5_flags, p5_impossible, p5_stuck, p6_found, p6_kinds, p6_unified)}

_SEGMENT = """z AS (SELECT DISTINCT zone_key, zone_id, effective_from f, effective_to t FROM dim_zone WHERE zone_id IS NOT NULL AND effective_from IS NOT NULL)"""
_VALID = """v AS (SELECT trip_id, pickup_ts, zone_id, arg_max(zone_key, (f, zone_key)) zone_key
 FROM (SELECT DISTINCT trip_id, pickup_ts, pickup_zone_id FROM fact_trips) r JOIN z ON r.pickup_zone_id = z.zone_id AND z.f <= r.pickup_ts AND (z.t IS NULL OR r.pickup_ts < z.t)
 GROUP BY trip_id, pickup_ts, zone_id)"""
_HISTORY = r"""n AS (SELECT snapshot_date, CAST(regexp_replace(locationid, '[\s\x{00a0}]+', '', 'g') AS INTEGER) zone_id, _ingested_at,
  nullif(regexp_replace(borough, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g'), '') borough, nullif(regexp_replace(zone_name, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g'), '') zone_name,
  nullif(regexp_replace(service_zone, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g'), '') service_zone
  FROM taxi_zone_lookup WHERE snapshot_date IS NOT NULL AND regexp_full_match(regexp_replace(locationid, '[\s\x{00a0}]+', '', 'g'), '[0-9]+')),
 one AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY snapshot_date, zone_id ORDER BY _ingested_at DESC, borough DESC NULLS LAST, zone_name DESC NULLS LAST, service_zone DESC NULLS LAST) = 1),
 days AS (SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date) no FROM (SELECT DISTINCT snapshot_date FROM n)),
 o AS (SELECT one.*, no FROM one JOIN days USING (snapshot_date)),
 l AS (SELECT *, CASE WHEN lag(no) OVER w = no - 1 AND lag(borough) OVER w IS NOT DISTINCT FROM borough AND lag(zone_name) OVER w IS NOT DISTINCT FROM zone_name
   AND lag(service_zone) OVER w IS NOT DISTINCT FROM service_zone THEN 0 ELSE 1 END new FROM o WINDOW w AS (PARTITION BY zone_id ORDER BY no)),
 g AS (SELECT *, sum(new) OVER (PARTITION BY zone_id ORDER BY no) ver FROM l),
 h AS (SELECT zone_id, ver, any_value(borough) borough, any_value(zone_name) zone_name, any_value(service_zone) service_zone, min(no) a, max(no) b FROM g GROUP BY zone_id, ver),
 hist AS (SELECT zone_id, borough, zone_name, service_zone, x.snapshot_date valid_from, y.snapshot_date valid_to FROM h JOIN days x ON x.no = a LEFT JOIN days y ON y.no = b + 1)"""
_ORPHANS = """d AS (SELECT 'pickup_zone_id' ref_field, zone_id id, effective_from f, effective_to t FROM dim_zone UNION ALL SELECT 'vendor_id', vendor_id, created_at, deleted_at FROM dim_vendor
 UNION ALL SELECT 'payment_type_id', payment_type_id, created_at, deleted_at FROM dim_payment_type UNION ALL SELECT 'rate_code_id', rate_code_id, created_at, deleted_at FROM dim_rate_code),
 r AS (SELECT DISTINCT trip_id, pickup_ts, ref_field, id FROM (
  SELECT trip_id, pickup_ts, 'pickup_zone_id' ref_field, pickup_zone_id id FROM fact_trips UNION ALL SELECT trip_id, pickup_ts, 'vendor_id', vendor_id FROM fact_trips
  UNION ALL SELECT trip_id, pickup_ts, 'payment_type_id', payment_type_id FROM fact_trips UNION ALL SELECT trip_id, pickup_ts, 'rate_code_id', rate_code_id FROM fact_trips) WHERE id IS NOT NULL),
 k AS (SELECT trip_id, pickup_ts, r.ref_field, count(d.id) n, min(f) first, count(*) FILTER (f <= pickup_ts AND (t IS NULL OR pickup_ts < t)) valid
  FROM r LEFT JOIN d ON r.ref_field = d.ref_field AND r.id = d.id GROUP BY trip_id, pickup_ts, r.ref_field),
 orphans AS (SELECT DISTINCT trip_id, ref_field, CAST(year(pickup_ts) * 100 + month(pickup_ts) AS INTEGER) AS month,
  CASE WHEN n = 0 THEN 'missing' WHEN pickup_ts < first THEN 'later' ELSE 'deleted' END orphan_kind FROM k WHERE n = 0 OR (pickup_ts IS NOT NULL AND valid = 0))"""

_RAW = {"record_id": "integer", "meter_id": "text", "vendorid": "integer", "tpep_pickup_datetime": "timestamp", "tpep_dropoff_datetime": "timestamp", "passenger_count": "integer",
        "trip_distance": "decimal", "ratecodeid": "integer", "store_and_fwd_flag": "text", "pulocationid": "integer", "dolocationid": "integer", "payment_type": "integer", "fare_amount": "decimal",
        "extra": "decimal", "mta_tax": "decimal", "tip_amount": "decimal", "tolls_amount": "decimal", "improvement_surcharge": "decimal", "total_amount": "decimal",
        "congestion_surcharge": "decimal", "airport_fee": "decimal"}
_KINDS = f"""j AS (SELECT _source_file f, _rescued_data r, unnest(json_keys(_rescued_data)) k FROM yellow_trips_raw WHERE _source_file IS NOT NULL AND json_valid(_rescued_data)),
 x AS (SELECT f, k AS name, json_type(r, '$."' || k || '"') t, json_extract_string(r, '$."' || k || '"') v FROM j WHERE k <> '_file_path'),
 held AS (SELECT f, unnest([{", ".join(f"'{c}'" for c in _RAW)}]) AS name, unnest([{", ".join(f"'{k}'" for k in _RAW.values())}]) AS kind, unnest([{", ".join(f"CAST({c} AS VARCHAR)" for c in _RAW)}]) v
  FROM (SELECT *, _source_file f FROM yellow_trips_raw WHERE _source_file IS NOT NULL)),
 vals AS (SELECT f, name, kind, v FROM held WHERE v IS NOT NULL UNION ALL SELECT f, name, CASE WHEN t IN ('UBIGINT', 'BIGINT') THEN 'integer' WHEN t = 'DOUBLE' THEN 'decimal' WHEN t = 'VARCHAR' THEN 'text' ELSE lower(t) END, v FROM x WHERE t <> 'NULL'),
 kinds AS (SELECT f AS file, name, kind, count(*) AS n FROM vals GROUP BY ALL)"""
#: Changes of consecutive files; a strange name is the column, empty in its file, whose values in other files are spread most alike.
_DRIFT = f"""{_KINDS}, plain AS (SELECT DISTINCT file, name, lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) pn FROM kinds),
 cols AS (SELECT c, regexp_replace(c, '[^a-z0-9]', '', 'g') pn FROM (SELECT unnest([{", ".join(f"'{c}'" for c in _RAW)}]) c)),
 strange AS (SELECT file, name FROM plain WHERE pn NOT IN (SELECT pn FROM cols)),
 free AS (SELECT s.file, s.name, c FROM strange s CROSS JOIN cols WHERE NOT EXISTS (SELECT 1 FROM plain p WHERE p.file = s.file AND p.pn = cols.pn)),
 cells AS (SELECT f, name, CASE WHEN regexp_matches(v, '\\d\\d:\\d\\d:\\d\\d') THEN 'h' WHEN TRY_CAST(v AS DOUBLE) = 0 THEN '0' WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN CASE WHEN CAST(v AS DOUBLE) < 0 THEN 'n' ELSE 'p' END || CAST(round(ln(abs(CAST(v AS DOUBLE))) / ln(1.05)) AS VARCHAR) ELSE 't' || lower(trim(v)) END cell FROM vals),
 many AS (SELECT f, name, cell, count(*) n FROM cells GROUP BY f, name, cell), spread AS (SELECT f, name, cell, n / sum(n) OVER (PARTITION BY f, name) sh FROM many),
 held_in AS (SELECT name, count(DISTINCT f) files FROM spread GROUP BY name), pool AS (SELECT name c, cell, sum(sh) / any_value(files) sh FROM spread JOIN held_in USING (name) WHERE name IN (SELECT c FROM cols) GROUP BY name, cell),
 likeness AS (SELECT free.file, free.name, free.c, sum(least(a.sh, b.sh)) l FROM free JOIN spread a ON a.f = free.file AND a.name = free.name JOIN pool b ON b.c = free.c AND b.cell = a.cell GROUP BY ALL),
 found AS (SELECT file, name, arg_max(c, l) c FROM likeness WHERE l > 0.6 GROUP BY file, name),
 main AS (SELECT file, name, arg_max(kind, n) kind FROM kinds GROUP BY file, name),
 fields AS (SELECT m.file, coalesce(found.c, cols.c, m.name) field, m.name, m.kind FROM main m LEFT JOIN found USING (file, name) LEFT JOIN cols ON cols.pn = lower(regexp_replace(m.name, '[^A-Za-z0-9]', '', 'g'))),
 files AS (SELECT _source_file file, row_number() OVER (ORDER BY min(_ingested_at), _source_file) no FROM yellow_trips_raw WHERE _source_file IS NOT NULL GROUP BY 1),
 now AS (SELECT no, files.file, field, name, kind FROM fields JOIN files USING (file)),
 both_ AS (SELECT f.file, coalesce(a.field, b.field) field, a.name an, b.name bn, a.kind ak, b.kind bk FROM now a FULL JOIN now b ON b.no = a.no + 1 AND a.field = b.field JOIN files f ON f.no = coalesce(b.no, a.no + 1))
SELECT file AS source_file, field AS field_name, change_kind FROM (SELECT *, unnest([CASE WHEN an IS NULL THEN 'added' WHEN bn IS NULL THEN 'removed' WHEN an <> bn THEN 'renamed' END, CASE WHEN ak <> bk THEN 'retyped' END]) change_kind FROM both_) WHERE change_kind IS NOT NULL AND file <> (SELECT file FROM files WHERE no = 1)"""
#: What the files call the columns besides their own names.
_SPELLINGS = {"airport_fee": ["Airport_fee"], "ratecodeid": ["rate_code"], "pulocationid": ["pu_location_id"], "tip_amount": ["tipAmount", "tip_amt"]}


def _unified(c: str, kind: str) -> str:
    rest = "coalesce(" + ", ".join(f"json_extract_string(r, '$.\"{n}\"')" for n in [c, *_SPELLINGS.get(c, [])]) + ")"
    if kind == "timestamp":
        return f"coalesce({c}, try_strptime({rest}, '%d.%m.%Y %H:%M:%S'), CAST(epoch_ms(TRY_CAST({rest} AS BIGINT)) AS TIMESTAMP)) AS {c}"
    if kind == "text":
        return f"coalesce({c}, {rest}) AS {c}"
    return f"coalesce({c}, TRY_CAST({rest} AS DOUBLE)) AS {c}" if kind == "decimal" else f"coalesce({c}, CAST(TRY_CAST({rest} AS DOUBLE) AS {'BIGINT' if c == 'record_id' else 'INTEGER'})) AS {c}"


def _further(n: str) -> str:
    """A field without a column is text; decimal numbers are written without trailing zeros."""
    v = f"json_extract_string(r, '$.\"{n}\"')"
    return f"CASE WHEN json_type(r, '$.\"{n}\"') = 'DOUBLE' THEN rtrim(rtrim({v}, '0'), '.') ELSE {v} END AS {n}"


_READINGS = f"""v AS (SELECT trip_id, meter_id, pickup_ts, unnest([{", ".join(f"'{r.name}'" for r in READINGS)}]) AS reading, unnest([{", ".join(r.name for r in READINGS)}]) AS v,
 unnest([{", ".join(f"{r.highest}" for r in READINGS)}]) AS most FROM (SELECT DISTINCT trip_id, meter_id, pickup_ts, {", ".join(r.name for r in READINGS)} FROM yellow_trips))"""

_STUCK = """n AS (SELECT *, CASE WHEN v IS NOT DISTINCT FROM lag(v) OVER w AND v IS NOT NULL THEN 0 ELSE 1 END AS new FROM v WHERE meter_id IS NOT NULL WINDOW w AS (PARTITION BY meter_id, reading ORDER BY pickup_ts NULLS FIRST, trip_id)),
 g AS (SELECT *, sum(new) OVER (PARTITION BY meter_id, reading ORDER BY pickup_ts NULLS FIRST, trip_id) AS g FROM n),
 stuck AS (SELECT DISTINCT trip_id, reading FROM g QUALIFY count(*) OVER (PARTITION BY meter_id, reading, g) >= 6 AND v IS NOT NULL)"""
_QUARTILES = ", ".join(f"(min(cell) FILTER (c >= t * {p}) + 0.5) * ln(1 + {spikes.CELL}) AS q{i}" for i, p in ((1, 0.25), (2, 0.5), (3, 0.75)))
_HALF = round(spikes.HALF_WINDOW / spikes.STEP)
#: Sketches, levels, fitted expansions, fences and jumps, step by step as the operator's docstrings define them.
_SPIKES = f"""{_READINGS}, {_STUCK}, c AS (SELECT *, CAST(floor(coalesce(hour(pickup_ts), 0) * 4 / 24) AS INTEGER) AS ctx FROM v),
 sk AS (SELECT meter_id AS s, ctx, reading, CAST(floor(ln(v) / ln(1 + {spikes.CELL})) AS INTEGER) AS cell, count(*) AS n FROM c WHERE meter_id IS NOT NULL AND v > 0 AND v <= most GROUP BY ALL),
 wr AS (SELECT *, sum(n) OVER (PARTITION BY s, reading ORDER BY cell) AS c, sum(n) OVER (PARTITION BY s, reading) AS t FROM (SELECT s, reading, cell, sum(n) AS n FROM sk GROUP BY ALL)),
 w AS (SELECT s, reading, max(t) AS n, {_QUARTILES} FROM wr GROUP BY s, reading HAVING max(t) >= {spikes.LEAST_READINGS}),
 p AS (SELECT reading, sum(n * (q2 - q1)) / sum(n) AS pd, sum(n * (q3 - q2)) / sum(n) AS pu FROM w GROUP BY reading),
 pr AS (SELECT *, sum(n) OVER (PARTITION BY s, ctx, reading ORDER BY cell) AS c, sum(n) OVER (PARTITION BY s, ctx, reading) AS t FROM sk),
 part AS (SELECT s, ctx, reading, max(t) AS cn, {_QUARTILES} FROM pr GROUP BY s, ctx, reading),
 lv AS (SELECT w.s, x.ctx, w.reading, (coalesce(part.q2, w.q2) * coalesce(cn, 0) + w.q2 * {spikes.CONTEXT_WEIGHT}) / (coalesce(cn, 0) + {spikes.CONTEXT_WEIGHT}) AS level,
  ((w.q2 - w.q1) * w.n + pd * {spikes.SPREAD_WEIGHT}) / (w.n + {spikes.SPREAD_WEIGHT}) AS down, ((w.q3 - w.q2) * w.n + pu * {spikes.SPREAD_WEIGHT}) / (w.n + {spikes.SPREAD_WEIGHT}) AS up
  FROM w JOIN p USING (reading) CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS ctx) x LEFT JOIN part ON part.s = w.s AND part.ctx = x.ctx AND part.reading = w.reading),
 d AS (SELECT reading, x > 0 AS above, CAST(round((CASE WHEN x > 0 THEN x - up ELSE -x - down END) / greatest(up + down, {spikes.CELL}) / {spikes.STEP}) AS INTEGER) AS away, n
  FROM (SELECT sk.reading, (cell + 0.5) * ln(1 + {spikes.CELL}) - level AS x, up, down, n FROM sk JOIN lv ON sk.s = lv.s AND sk.ctx = lv.ctx AND sk.reading = lv.reading)),
 grid AS (SELECT reading, above, k FROM (SELECT DISTINCT reading FROM lv), (SELECT unnest([true, false]) AS above), (SELECT unnest(range({round(spikes.EXPANSIONS[0] / spikes.STEP)}, {round(spikes.EXPANSIONS[1] / spikes.STEP)} + 1)) AS k)),
 score AS (SELECT g.reading, g.above, k, coalesce(sum(n), 0) + 0.5 * abs(k * {spikes.STEP} - {spikes.EXPANSION}) AS score FROM grid g LEFT JOIN d ON d.reading = g.reading AND d.above = g.above AND away BETWEEN k - {_HALF} AND k + {_HALF} GROUP BY g.reading, g.above, k),
 ex AS (SELECT reading, arg_min(k, (score, k)) FILTER (above) * {spikes.STEP} AS eu, arg_min(k, (score, k)) FILTER (NOT above) * {spikes.STEP} AS ed FROM score GROUP BY reading),
 fence AS (SELECT s, ctx, lv.reading, exp(level - down - iqr * ed) AS lo, exp(level + up + iqr * eu) AS hi, exp(level - down - iqr * {spikes.INNER}) AS ilo, exp(level + up + iqr * {spikes.INNER}) AS ihi
  FROM (SELECT *, greatest(up + down, {spikes.CELL}) AS iqr FROM lv) lv JOIN ex USING (reading)),
 nb AS (SELECT *, lag(v) OVER o AS pv, lead(v) OVER o AS nv FROM c WINDOW o AS (PARTITION BY meter_id, reading ORDER BY pickup_ts NULLS FIRST, trip_id)),
 j AS (SELECT nb.*, lo, hi, ilo, ihi, isnan(v) OR v < 0 OR v > most AS bad FROM nb LEFT JOIN fence ON fence.s = nb.meter_id AND fence.ctx = nb.ctx AND fence.reading = nb.reading),
 flags AS (SELECT trip_id, reading, 'impossible' AS reason FROM j WHERE bad UNION SELECT trip_id, reading, CASE WHEN v > hi THEN 'above fence' ELSE 'below fence' END FROM j WHERE NOT bad AND (v > hi OR v < lo)
  UNION SELECT trip_id, reading, 'jump' FROM j WHERE (v > ihi OR v < ilo) AND NOT isnan(v) AND NOT isnan(pv) AND NOT isnan(nv) AND v > 0 AND pv > 0 AND nv > 0
   AND CASE WHEN v > 0 AND pv > 0 AND nv > 0 THEN abs(ln(v) - ln(pv)) > ln({spikes.JUMP}) AND abs(ln(v) - ln(nv)) > ln({spikes.JUMP}) END
  UNION SELECT trip_id, reading, 'stuck' FROM stuck)"""

ORACLE = {
    "p5_flags": f"WITH {_SPIKES} SELECT * FROM flags",
    "p5_found": f"WITH {_SPIKES} SELECT DISTINCT trip_id FROM flags",
    "p5_impossible": f"WITH {_READINGS} SELECT DISTINCT trip_id, reading FROM v WHERE isnan(v) OR v < 0 OR v > most",
    "p5_stuck": f"WITH {_READINGS}, {_STUCK} SELECT * FROM stuck",
    "p6_unified": "SELECT " + ", ".join(_unified(c, k) for c, k in _RAW.items()) + ", " + ", ".join(map(_further, ("cbd_fee", "driver_note", "trip_mode")))
                  + ", _source_file, _ingested_at FROM (SELECT *, _rescued_data AS r FROM yellow_trips_raw)",
    "p6_kinds": f"WITH {_KINDS} SELECT * FROM kinds",
    "p6_found": f"WITH {_DRIFT}",
    "p1_found": f"WITH {_SEGMENT}, {_VALID}, w AS (SELECT zone_id, arg_max(zone_key, (f, zone_key)) newest FROM z GROUP BY zone_id) SELECT DISTINCT trip_id, zone_key FROM v JOIN w USING (zone_id) WHERE zone_key <> newest",
    "p1_enriched": f"""WITH {_SEGMENT}, {_VALID}, a AS (SELECT DISTINCT zone_key, borough, zone_name, service_zone FROM dim_zone)
SELECT r.trip_id, r.pickup_ts, r.pickup_zone_id, v.zone_key, a.borough, a.zone_name, a.service_zone FROM fact_trips r
LEFT JOIN v ON r.trip_id = v.trip_id AND r.pickup_ts = v.pickup_ts AND r.pickup_zone_id = v.zone_id LEFT JOIN a USING (zone_key)""",
    "p2_found": f"WITH {_ORPHANS} SELECT DISTINCT trip_id, ref_field, orphan_kind FROM orphans",
    "p2_counts": f"WITH {_ORPHANS} SELECT ref_field, month, orphan_kind, count(*) orphans FROM orphans GROUP BY ALL",
    "p3_found": f"WITH {_HISTORY} SELECT zone_id, CAST(strftime(valid_from, '%Y%m%d') AS INTEGER) valid_from_day, coalesce(CAST(strftime(valid_to, '%Y%m%d') AS INTEGER), 99991231) valid_to_day FROM hist",
    "p3_changes": f"""WITH {_HISTORY}, c AS (SELECT cur.zone_id k, cur.no, prev.zone_id had, cur.borough IS NOT DISTINCT FROM prev.borough AND cur.zone_name IS NOT DISTINCT FROM prev.zone_name
  AND cur.service_zone IS NOT DISTINCT FROM prev.service_zone same FROM o cur LEFT JOIN o prev ON cur.zone_id = prev.zone_id AND cur.no = prev.no + 1),
 e AS (SELECT k, no, CASE WHEN had IS NULL THEN 'inserted' ELSE 'changed' END change FROM c WHERE had IS NULL OR NOT same
  UNION ALL SELECT prev.zone_id, prev.no + 1, 'deleted' FROM o prev LEFT JOIN o cur ON cur.zone_id = prev.zone_id AND cur.no = prev.no + 1 WHERE cur.zone_id IS NULL)
SELECT k AS zone_id, snapshot_date, change FROM e JOIN days USING (no)""",
    "p3_history": f"WITH {_HISTORY} SELECT zone_id, borough, zone_name, service_zone, valid_from, valid_to FROM hist",
}
