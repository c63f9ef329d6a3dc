"""Queries of the pipeline's own operators over the test tables, and their SQL."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.contract import TRIPS
from millrace.functions.hashing import surrogate_hash
from millrace.operators import gold, merge, scd2, silver
from millrace.operators.asof import AsOf
from millrace.plans import bi
from millrace.plans.training import ZONE, ZONE_ATTRIBUTES, zone_snapshots
from millrace.quality import recon
from millrace.quality.rules import DQRule, Evaluator, duplicated_groups, load_rules, orphan_rows
from millrace.session import Scratch, table
from millrace.sources.files import count_rows, csv_snapshot
from millrace.sources.fs import Files
from millrace.store import Store

NOW = "2024-07-31 00:00:00"
#: Files that arrived before this are a batch of their own in the merge and incremental queries.
CUT = "2024-01-01 00:00:00"
#: The snapshots that the SCD2 queries compare.
FIRST_SNAPSHOT, NEXT_SNAPSHOT = "2023-01-01", "2024-06-01"


def raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "yellow_trips_raw")


def trips(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "yellow_trips")


def fact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fact_trips")


# ---- silver ----

def standardize(spark, d):
    return silver.standardize(raw(spark, d))


def dedup_latest(spark, d):
    keyed = raw(spark, d).select("record_id", *[F.col(c).alias(n) for c, n in zip(RAW_KEY, TRIPS.key)], "_ingested_at")
    return silver.latest_per_key(keyed, TRIPS.key, "_ingested_at", ["record_id"])


RAW_KEY = ["vendorid", "tpep_pickup_datetime", "tpep_dropoff_datetime", "pulocationid", "dolocationid", "total_amount"]


def _flagged(spark, d):
    cols = {k.lower(): v for k, v in TRIPS.renames.items()}
    rows = raw(spark, d)
    return silver.flag_violations(rows.select("record_id", *[F.col(c).alias(cols.get(c, c)) for c in rows.columns if cols.get(c, c) in TRIPS.columns]))


def validity_flags(spark, d):
    return _flagged(spark, d).select("record_id", F.array_join("dq_violations", ",").alias("violations"))


def split_clean(spark, d):
    return silver.split(_flagged(spark, d))[0].select("record_id", "pickup_ts", "total_amount")


def split_quarantine(spark, d):
    return silver.split(_flagged(spark, d))[1].select("record_id", "pickup_ts", "total_amount", F.array_join("dq_violations", ",").alias("violations"))


def quarantine_reasons(spark, d):
    return silver.quarantine_reasons(silver.split(_flagged(spark, d))[1])


def derived_columns(spark, d):
    rows = trips(spark, d).select("trip_id", *TRIPS.columns)
    return silver.derive(rows, rounding="floor").select("trip_id", "pickup_date", "pickup_hour", "trip_minutes", "avg_speed_mph", "tip_pct")


def derived_half_up(spark, d):
    """As the pipeline rounds."""
    rows = trips(spark, d).select("trip_id", *TRIPS.columns)
    return silver.derive(rows).select("trip_id", "trip_minutes", "avg_speed_mph", "tip_pct")


def surrogate_hashes(spark, d):
    rows = trips(spark, d)
    return rows.select("trip_id", surrogate_hash(rows, TRIPS.key).alias("trip_hash"))


def silver_full(spark, d):
    """All steps in order over the raw table: rows and rows with a violation per file."""
    rows = silver.tagged(raw(spark, d), rounding="floor")
    return rows.groupBy("_source_file").agg(F.count("*").alias("n"), F.count_if(F.size("dq_violations") > 0).alias("bad"))


# ---- merge and incremental ----

def incremental_files(spark, d):
    rows = trips(spark, d).select("trip_id", "_source_file", "_ingested_at")
    done = merge.processed_files(rows.filter(F.col("_ingested_at") < F.lit(CUT).cast("timestamp_ntz")))
    return merge.unprocessed(rows, done).select("trip_id", "_source_file")


def merge_insert_only(spark, d):
    rows = trips(spark, d).select("trip_hash", "trip_id", "_ingested_at")
    cut = F.lit(CUT).cast("timestamp_ntz")
    first = lambda x: silver.latest_per_key(x, ["trip_hash"], "_ingested_at", ["trip_id"])
    return merge.merge_insert(first(rows.filter(F.col("_ingested_at") < cut)), first(rows.filter(F.col("_ingested_at") >= cut)), ["trip_hash"]).select("trip_hash", "trip_id")


# ---- dimensions ----

def dim_date(spark, d):
    return gold.dim_date(spark, "2023-01-01", "2024-06-30")


def dim_static_seed(spark, d):
    parts = [gold.seed(spark, n).toDF("id", "name").select(F.lit(n).alias("dim"), "id", "name") for n in gold.SEEDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _snapshot(spark, d, day):
    return zone_snapshots(spark, d).filter(F.col("snapshot_date") == F.lit(day).cast("date")).drop("snapshot_date")


def scd2_initial(spark, d):
    return scd2.scd2_initial(_snapshot(spark, d, FIRST_SNAPSHOT), "zone_id", ZONE_ATTRIBUTES, "2023-01-01 00:00:00")


def scd2_change(spark, d):
    return scd2.scd2_apply(scd2_initial(spark, d), _snapshot(spark, d, NEXT_SNAPSHOT), "zone_id", ZONE_ATTRIBUTES, "2024-06-01 00:00:00").dimension


def scd2_noop(spark, d):
    first = scd2_initial(spark, d)
    return scd2.scd2_apply(first, _snapshot(spark, d, FIRST_SNAPSHOT), "zone_id", ZONE_ATTRIBUTES, "2024-06-01 00:00:00").dimension


def scd2_all_snapshots(spark, d):
    """Every snapshot in order of its day applied to the dimension that the ones before it left; each state is written."""
    scratch, rows = Scratch(spark, "scd2"), zone_snapshots(spark, d)
    rows = scratch.write(rows, "snapshots")
    dim = None
    for day in [str(r[0]) for r in rows.select("snapshot_date").distinct().orderBy("snapshot_date").collect()]:  # one a month
        source = rows.filter(F.col("snapshot_date") == F.lit(day).cast("date")).drop("snapshot_date")
        dim = scratch.write(scd2.scd2_apply(dim, source, "zone_id", ZONE_ATTRIBUTES, f"{day} 00:00:00").dimension, f"dim-{day}")
    return dim if dim is not None else scd2.scd2_initial(rows.drop("snapshot_date"), "zone_id", ZONE_ATTRIBUTES, NOW)


def scd2_as_was(spark, d):
    """Rides per borough as it was at pickup; rides without a version stand under null."""
    asof = AsOf(table(spark, d, "dim_zone"), ZONE, ZONE_ATTRIBUTES)
    rides = fact(spark, d).select("trip_id", "pickup_ts", "pickup_zone_id")
    return asof.enrich(rides, "pickup_zone_id", "pickup_ts").groupBy("borough").agg(F.count("*").alias("trips"))


# ---- fact and marts ----

def build_fact(spark, d):
    return gold.build_fact(trips(spark, d))


def _daily(spark, d):
    return gold.mart_daily(fact(spark, d), gold.current_zones(table(spark, d, "dim_zone")), "floor")


def mart_daily(spark, d):
    return _daily(spark, d)


def mart_monthly(spark, d):
    return gold.mart_monthly(fact(spark, d), "floor")


def mart_daily_half_up(spark, d):
    return gold.mart_daily(fact(spark, d), gold.current_zones(table(spark, d, "dim_zone")))


def mart_monthly_half_up(spark, d):
    return gold.mart_monthly(fact(spark, d))


# ---- BI ----

def bi_monthly_kpis(spark, d):
    return bi.monthly_kpis(mart_monthly(spark, d))


def bi_top_zones(spark, d):
    return bi.top_zones(_daily(spark, d), rounding="floor")


def bi_demand_heatmap(spark, d):
    return bi.demand_heatmap(fact(spark, d), gold.dim_date(spark, "2023-01-01", "2024-06-30"))


def bi_payment_mix(spark, d):
    return bi.payment_mix(fact(spark, d), table(spark, d, "dim_payment_type"), "floor")


def bi_ops_health(spark, d):
    dq = dq_scorecard(spark, d).withColumn("checked_at", F.lit(NOW).cast("timestamp_ntz"))
    checks = recon_silver_gold(spark, d).withColumn("checked_at", F.lit(NOW).cast("timestamp_ntz"))
    return bi.ops_health(dq, checks, "2024-08-01")


def bi_duplicate_hashes(spark, d):
    return bi.duplicate_hashes(trips(spark, d))


def bi_rows_per_file(spark, d):
    return bi.rows_per_file(raw(spark, d))


# ---- quality ----

RULES = [
    DQRule("not_null_pickup", "fact_trips", "not_null", "gold", "error", "pickup_ts"),
    DQRule("unique_hash", "yellow_trips", "unique", "silver", "error", "trip_hash"),
    DQRule("amount_range", "yellow_trips", "range", "silver", "error", "total_amount", min=0, max=10000),
    DQRule("distance_range", "yellow_trips", "range", "silver", "error", "trip_distance", min=0, max=500),
    DQRule("payment_accepted", "fact_trips", "accepted_values", "gold", "warn", "payment_type_id", values=(0, 1, 2, 3, 4, 5, 6)),
    DQRule("trips_present", "yellow_trips", "row_count_min", "silver", "error", threshold=1),
    DQRule("fresh", "yellow_trips_raw", "freshness", "bronze", "warn", "_ingested_at", max_age_days=20),
    DQRule("zones_known", "fact_trips", "referential", "gold", "warn", "pickup_zone_id", ref_table="taxi_zone_lookup", ref_column="locationid"),
]


def _dq(spark, d, *names: str) -> DataFrame:
    ev = Evaluator(spark, lambda n: table(spark, d, n), NOW)
    return ev.results([r for r in RULES if r.name in names or not names], "run", "dev").select("rule_name", "table_name", "rule_type", "severity", "total_rows", "failed_rows", "passed")


def dq_not_null(spark, d):
    return _dq(spark, d, "not_null_pickup")


def dq_unique(spark, d):
    return duplicated_groups(trips(spark, d), ["trip_hash"])


def dq_accepted_values(spark, d):
    return _dq(spark, d, "payment_accepted")


def dq_range(spark, d):
    return _dq(spark, d, "amount_range", "distance_range")


def dq_row_count_min(spark, d):
    return _dq(spark, d, "trips_present")


def dq_freshness(spark, d):
    return _dq(spark, d, "fresh")


def dq_referential(spark, d):
    return orphan_rows(fact(spark, d), "pickup_zone_id", table(spark, d, "taxi_zone_lookup"), "locationid")


def dq_scorecard(spark, d):
    return _dq(spark, d)


# ---- reconciliation ----

def recon_source_bronze(spark, d):
    """Rows per file: the raw table stands for the manifest, the trusted table for what arrived."""
    manifest = raw(spark, d).groupBy(F.col("_source_file").alias("file_name")).agg(F.count("*").alias("source_row_count")).withColumn("status", F.lit("LANDED"))
    return recon.source_vs_bronze(manifest, trips(spark, d))


def recon_bronze_silver(spark, d):
    """Keys of the raw table against those of the clean and the quarantined rows that the silver steps make of it."""
    bronze = raw(spark, d)
    clean, bad = silver.split(Scratch(spark, "recon").write(silver.tagged(bronze).select("trip_hash", "dq_violations"), "tagged"))
    return recon.bronze_vs_silver(bronze, clean, bad).unionByName(recon.clean_and_quarantined(clean, bad))


def recon_from_landing(spark, d):
    """Rows of every landed file by its footer against the rows that the ingest stream made of it."""
    root, _, names = _landed(spark, d)
    counted = [(n, count_rows(spark, f"{root}/yellow/{n}"), "LANDED") for n in names]  # a row a file
    manifest = spark.createDataFrame(counted, "file_name string, source_row_count bigint, status string")
    return recon.source_vs_bronze(manifest, _ingested(spark, d))


def recon_silver_gold(spark, d):
    return recon.rows_equal(trips(spark, d), fact(spark, d)).unionByName(recon.amounts_equal(trips(spark, d), fact(spark, d)))


def recon_fact_mart(spark, d):
    return recon.fact_vs_mart(fact(spark, d), _daily(spark, d))


# ---- ingest ----

def _landed(spark, d) -> tuple[str, StructType, list[str]]:
    """yellow_trips landed as the files it came from, all columns, one or more files each; files that arrived in 2024 have
    text distances, a renamed meter and a further column. (folder, tracked schema, file names)"""
    scratch, files = Scratch(spark, "landing"), Files(spark)
    rows = trips(spark, d).withColumn("_of", F.regexp_replace(F.coalesce("_source_file", F.lit("unnamed")), r"\.parquet$", "")).drop("_source_file")
    cut = F.lit(CUT).cast("timestamp_ntz")
    early = rows.filter(F.col("_ingested_at") < cut).drop("_ingested_at")
    late = rows.filter(F.coalesce(F.col("_ingested_at") >= cut, F.lit(True))).drop("_ingested_at").withColumn("trip_distance", F.col("trip_distance").cast("string")).withColumnRenamed("meter_id", "Meter_Id").withColumn("fleet", F.lit("north"))
    root, names = scratch.root, []
    for part, name in ((early, "early"), (late, "late")):
        part.write.partitionBy("_of").parquet(f"{root}/parts/{name}")
        for folder in (x for x in files.names(f"{root}/parts/{name}") if x.startswith("_of=")):
            for i, f in enumerate(x for x in files.names(f"{root}/parts/{name}/{folder}") if x.endswith(".parquet")):
                names.append(f"{unquote(folder[4:])}-{i}.parquet")
                files.make(f"{root}/yellow")
                files.move(f"{root}/parts/{name}/{folder}/{f}", f"{root}/yellow/{names[-1]}")
    return root, early.drop("_of").schema, names


def _ingested(spark, d) -> DataFrame:
    from millrace.streaming.arrivals import load_new_files

    root, tracked, _ = _landed(spark, d)
    store = Store(spark, f"{root}/tables")
    for _ in range(2):  # the second time finds nothing new
        Files(spark).make(f"{root}/yellow")
        load_new_files(spark, store, f"{root}/yellow", "bronze.trips", tracked, f"{root}/checkpoint")
    return store.read("bronze.trips") if store.exists("bronze.trips") else spark.createDataFrame([], tracked.add("_source_file", "string").add("_rescued_data", "string"))


def ingest_file_stream(spark, d):
    return _ingested(spark, d).drop("meter_id", "trip_distance", "_source_file", "_ingested_at", "_rescued_data")


def ingest_schema_rescue(spark, d):
    rows = _ingested(spark, d)
    rest = lambda k: F.get_json_object("_rescued_data", f"$.{k}")
    return rows.select("trip_id", "meter_id", "trip_distance", rest("Meter_Id").alias("rescued_meter"), rest("trip_distance").alias("rescued_distance"), rest("fleet").alias("rescued_fleet"))


def ingest_lineage(spark, d):
    """The file that each ride's lineage names, without the number of the part."""
    return _ingested(spark, d).select("trip_id", F.regexp_replace("_source_file", r"-\d+\.parquet$", ".parquet").alias("file"))


def ingest_csv_snapshot(spark, d):
    """The zone lookup written as CSV and read back: every column is text, blanks stay, empty text is null."""
    scratch = Scratch(spark, "csv")
    cols = ["locationid", *ZONE_ATTRIBUTES]
    table(spark, d, "taxi_zone_lookup").select(F.col("snapshot_date").cast("string").alias("snapshot_date"), *cols).write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{scratch.root}/zones")
    return csv_snapshot(spark, f"{scratch.root}/zones").select("snapshot_date", *cols)


# ---- the store and the pipeline ----

def store_history(spark, d):
    """Rows per state of one table: written, replaced, appended to, merged into, compacted, restored, vacuumed."""
    store = Store(spark, f"{Scratch(spark, 'store').root}/tables")
    rows = trips(spark, d).select("trip_hash", "trip_id", "pickup_date", "_ingested_at")
    cut = F.lit(CUT).cast("timestamp_ntz")
    early, late = rows.filter(F.col("_ingested_at") < cut), rows.filter(F.col("_ingested_at") >= cut)
    first = lambda x: silver.latest_per_key(x, ["trip_hash"], "_ingested_at", ["trip_id"])
    out = []
    note = lambda state: out.append((state, store.count("t.rides"), store.read("t.rides").agg(F.sum("trip_id")).first()[0]))
    store.overwrite("t.rides", rows)
    note("written")
    store.overwrite("t.rides", first(early), ["pickup_date"])
    note("replaced")
    store.merge_insert("t.rides", first(late), ["trip_hash"], "late", "pickup_date")
    store.merge_insert("t.rides", first(late), ["trip_hash"], "again", "pickup_date")
    note("merged")
    store.append("t.rides", early, "more")
    store.append("t.rides", early, "more")
    note("appended")
    store.compact("t.rides", cluster_by=["pickup_date"])
    note("compacted")
    store.restore("t.rides", 1)
    note("restored")
    store.vacuum("t.rides", 0)
    note("vacuumed")
    return spark.createDataFrame(out, "state string, n bigint, ids bigint")


def _pipeline(spark, d):
    """The stages from silver on over yellow_trips_raw as bronze, in two runs: the files of 2023, then the rest."""
    from millrace.config import Settings
    from millrace.ops import runner

    root = Scratch(spark, "pipeline").root
    rows = raw(spark, d).drop("record_id", "meter_id", "_rescued_data")
    cut = F.lit(CUT).cast("timestamp_ntz")
    zones = zone_snapshots(spark, d)
    last = F.lit(zones.agg(F.max("snapshot_date")).first()[0]).cast("date")
    zones = zones.filter(F.col("snapshot_date") == last).select(F.col("zone_id").cast("string").alias("LocationID"), F.col("borough").alias("Borough"), F.col("zone_name").alias("Zone"), "service_zone")
    out = []
    for no, part in enumerate((rows.filter(F.col("_ingested_at") < cut), rows.filter(F.col("_ingested_at") >= cut))):
        p = runner.Pipeline(spark, Settings(root, run_id=f"run{no}"), now=f"2024-08-0{no + 1} 00:00:00", fail_on_mismatch=False)
        p.setup()
        p.store.append(runner.BRONZE, part, f"part{no}")
        p.store.append(runner.ARRIVED, part.select("_source_file").distinct(), f"part{no}")
        p.store.overwrite(runner.ZONES, zones)
        out.append(p.run(["silver_transform", "gold_dimensions", "gold_fact", "gold_aggregates", "reconciliation"]))
    return p.store, out


def pipeline_tables(spark, d):
    """Rows and, where there is one, the total amount of every table that two runs of the pipeline leave."""
    from millrace.ops import runner

    store, _ = _pipeline(spark, d)
    parts = []
    for name in (runner.CLEAN, runner.QUARANTINE, runner.FACT, runner.DAILY, "gold.dim_date", "gold.dim_zone"):
        df = store.read(name)
        total = gold.money("total_amount") if "total_amount" in df.columns else F.lit(None).cast("double")
        parts.append(df.agg(F.count("*").alias("n"), total.alias("total")).select(F.lit(name).alias("name"), "n", "total"))
    return reduce(DataFrame.unionByName, parts)


def pipeline_fact(spark, d):
    from millrace.ops import runner

    return _pipeline(spark, d)[0].read(runner.FACT).select("trip_hash", "date_key", "pickup_zone_id", "total_amount")


def pipeline_recon(spark, d):
    from millrace.ops import runner

    return _pipeline(spark, d)[0].read(runner.RECON).filter("scope = 'all'").select("run_id", "check_name", "source_value", "target_value", "passed")


def pipeline_audit(spark, d):
    from millrace.ops.audit import RUNS

    return _pipeline(spark, d)[0].read(RUNS).groupBy("run_id", "task_name", "status").agg(F.count("*").alias("n"))


def dq_rule_file(spark, d):
    """The rules of the trip feed, read from their file, over the test tables."""
    from millrace.ops.runner import RULES as FILE

    names = {"bronze.yellow_trips_raw": "yellow_trips_raw", "bronze.taxi_zone_lookup": "taxi_zone_lookup", "silver.yellow_trips": "yellow_trips"}
    ev = Evaluator(spark, lambda n: table(spark, d, names[n]), NOW)
    return ev.results(load_rules(FILE), "run", "dev").select("layer", "rule_name", "total_rows", "failed_rows", "passed")


QUERIES = {f.__name__: f for f in (
    standardize, dedup_latest, validity_flags, split_clean, split_quarantine, quarantine_reasons, derived_columns, surrogate_hashes, silver_full, incremental_files,
    merge_insert_only, dim_date, dim_static_seed, scd2_initial, scd2_change, scd2_noop, scd2_as_was, build_fact, mart_daily, mart_monthly, bi_monthly_kpis, bi_top_zones,
    bi_demand_heatmap, bi_payment_mix, bi_ops_health, bi_duplicate_hashes, bi_rows_per_file, dq_not_null, dq_unique, dq_accepted_values, dq_range, dq_row_count_min,
    dq_freshness, dq_referential, dq_scorecard, recon_source_bronze, recon_bronze_silver, recon_silver_gold, recon_fact_mart, ingest_file_stream, ingest_schema_rescue, ingest_lineage,
    derived_half_up, mart_daily_half_up, mart_monthly_half_up, scd2_all_snapshots, recon_from_landing, ingest_csv_snapshot, store_history, pipeline_tables, pipeline_fact, pipeline_recon,
    pipeline_audit, dq_rule_file)}
