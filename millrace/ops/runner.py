"""The pipeline: nine stages in order, each audited, tables as the only hand-over."""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.config import LAYERS, Settings, parse_flag
from millrace.operators import gold, silver
from millrace.operators.drift import LandedTable
from millrace.operators.merge import new_rows, unprocessed
from millrace.operators.scd2 import scd2_apply
from millrace.ops.audit import RUNS, RUNS_SCHEMA, AuditLog, audited
from millrace.quality import recon
from millrace.quality.rules import RESULT_SCHEMA, Evaluator, load_rules, run_checks
from millrace.session import build_session
from millrace.sources.files import csv_snapshot
from millrace.sources.fs import Files
from millrace.sources.lander import MANIFEST, MANIFEST_SCHEMA, land_month, land_reference
from millrace.store import Store, near
from millrace.streaming.arrivals import load_new_files

# Names of tables, stages and metrics are fixed values: other jobs read them.
BRONZE, ZONES = "bronze.yellow_trips_raw", "bronze.taxi_zone_lookup"
CLEAN, QUARANTINE = "silver.yellow_trips", "silver.yellow_trips_quarantine"
ARRIVED, FILES, MERGED = "ops.bronze_files", "ops.processed_files", "ops.fact_batches"
FACT, DAILY, MONTHLY = "gold.fact_trips", "gold.agg_daily_zone_revenue", "gold.agg_monthly_kpis"
DQ, RECON = "ops.dq_results", "ops.recon_results"
RECON_SCHEMA = "run_id string, env string, check_name string, scope string, source_value double, target_value double, difference double, passed boolean, checked_at timestamp_ntz"
RULES = os.path.join(os.path.dirname(__file__), "..", "..", "conf", "dq_rules.yml")


class Pipeline:
    """One run. `now` is the time of all its results and versions; `sources` gives a month's file, `zones` the zone lookup."""

    def __init__(self, spark: SparkSession, settings: Settings, sources: Callable[[str], str] | None = None, now: str | None = None, rules: str = RULES, tracked: StructType | None = None, zones: str | None = None, fail_on_mismatch: bool = True):
        self.spark, self.settings, self.sources, self.rules, self.zones = spark, settings, sources, rules, zones
        self.store, self.files = Store(spark, settings.tables), Files(spark)
        self.log = AuditLog(self.store, settings)
        self.now = now or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        self.tracked, self.fail_on_mismatch = tracked, fail_on_mismatch

    def setup(self) -> None:
        """Folders and the four ops tables; does nothing where they are."""
        for d in (*(f"{self.settings.tables}/{layer}" for layer in LAYERS), self.settings.landing, self.settings.landing_zones, self.settings.checkpoints):
            self.files.make(d)
        for name, ddl in ((RUNS, RUNS_SCHEMA), (DQ, RESULT_SCHEMA), (RECON, RECON_SCHEMA), (MANIFEST, MANIFEST_SCHEMA)):
            self.store.create(name, ddl)

    # ---- stages ----

    def ingest_landing(self) -> dict:
        if self.zones:
            land_reference(self.spark, self.settings.landing_zones, self.zones)
        if not self.sources or not self.settings.run_month:
            return {"skipped": True, "reason": "no source"}
        month = self.settings.run_month
        return land_month(self.spark, self.store, self.settings.landing, month, self.sources(month), self.settings.full_refresh)

    def bronze(self) -> dict:
        if self.tracked is None:  # the schema tracked since the first landing file
            first = [f for f in self.files.names(self.settings.landing) if f.endswith(".parquet")]
            if not first:
                return {"bronze_trips_total": 0, "bronze_zones": 0}
            if self.store.exists(BRONZE):
                own = {"_source_file", "_ingested_at", "_rescued_data"}
                self.tracked = StructType([f for f in self.store.read(BRONZE).schema.fields if f.name not in own])
            else:
                self.tracked = self.spark.read.parquet(f"{self.settings.landing}/{first[0]}").schema
        total = load_new_files(self.spark, self.store, self.settings.landing, BRONZE, self.tracked, f"{self.settings.checkpoints}/bronze", files=ARRIVED)
        zones = 0
        if any(f.endswith(".csv") for f in self.files.names(self.settings.landing_zones)):
            self.store.overwrite(ZONES, csv_snapshot(self.spark, self.settings.landing_zones))
            zones = self.store.count(ZONES)
        return {"bronze_trips_total": total, "bronze_zones": zones}

    def dq(self, layer: str) -> dict:
        ev = Evaluator(self.spark, self.store.read, self.now)
        return run_checks(ev, load_rules(self.rules, layer), self.settings.run_id, self.settings.env, lambda df: self.store.append(DQ, df))

    def silver(self) -> dict:
        """New files only, or everything on a full refresh.

        New files are found by name, from two small tables, and bronze is read for them alone: the list
        is pushed into the scan, which skips row groups of other files. It is taken before anything is
        written; the tagged rows are written once and both tables filled from them, and the files are
        recorded last, so a run that breaks off is repeated without loss.
        """
        raw = self.store.read(BRONZE)
        full = self.settings.full_refresh or not self.store.exists(CLEAN)
        files = self.store.read(ARRIVED).distinct()
        if not full and self.store.exists(FILES):
            files = unprocessed(files, self.store.read(FILES))
        names = [r[0] for r in files.collect()]  # names of new files
        if not names:
            if not self.store.exists(CLEAN):  # nothing has arrived at all
                none = silver.silver_columns(silver.tagged(raw.limit(0)), "dq_violations")
                self.store.overwrite(CLEAN, none.drop("dq_violations"))
                self.store.overwrite(QUARANTINE, none)
            return {"rows_in": 0, "rows_clean": 0, "rows_quarantined": 0, "skipped": True}
        if not full:
            raw = raw.filter(F.col("_source_file").isin(names))
        file_list = self.spark.createDataFrame([(n,) for n in names], "_source_file string")
        stage = "silver.stage"
        self.store.overwrite(stage, silver.silver_columns(silver.tagged(self._recovered(raw)), "dq_violations"))
        tagged = self.store.read(stage)
        clean, bad = silver.split(tagged)
        if full:
            self.store.overwrite(CLEAN, clean, ["pickup_date"])
            self.store.overwrite(QUARANTINE, bad)
            self.store.overwrite(FILES, file_list)
        else:
            # the first stored row of a key holds, in whichever of the two tables it stands
            days, run = near(tagged, "pickup_date"), self.settings.run_id
            held = {t: self.store.read(t).filter(days).select("trip_hash") for t in (CLEAN, QUARANTINE)}
            bad = new_rows(held[CLEAN], bad, ["trip_hash"])
            self.store.merge_insert(CLEAN, new_rows(held[QUARANTINE], clean, ["trip_hash"]), ["trip_hash"], run, "pickup_date")
            self.store.merge_insert(QUARANTINE, bad, ["trip_hash"], run, "pickup_date")
            self.store.append(FILES, file_list, self.settings.run_id)
        n = tagged.agg(F.count("*").alias("n"), F.count_if(F.size("dq_violations") == 0).alias("c")).first()
        self.store.vacuum(stage, 1)
        return {"rows_in": raw.count(), "rows_clean": n.c, "rows_quarantined": n.n - n.c, "skipped": False}

    def _recovered(self, raw: DataFrame) -> DataFrame:
        """Bronze rows with what was rescued put back into the column it belongs to, whatever the file calls it."""
        if "_rescued_data" not in raw.columns or raw.filter("_rescued_data IS NOT NULL").isEmpty():
            return raw
        return LandedTable(raw, "_source_file", "_ingested_at", "_rescued_data").unified()

    def dimensions(self) -> dict:
        bounds = gold.date_bounds(self.store.read(CLEAN))
        self.store.overwrite("gold.dim_date", gold.dim_date(self.spark, *(bounds or ("1970-01-02", "1970-01-01"))))  # no day without a ride
        days = self.store.count("gold.dim_date")
        for name in gold.SEEDS:
            self.store.overwrite(f"gold.{name}", gold.seed(self.spark, name))
        zones = {"inserted": 0, "expired": 0}
        if self.store.exists(ZONES):
            lookup = self.store.read(ZONES)
            source = lookup.select(F.col("LocationID").try_cast("int").alias("zone_id"), F.col("Borough").alias("borough"), F.col("Zone").alias("zone_name"), "service_zone").filter("zone_id IS NOT NULL")
            current = self.store.read("gold.dim_zone") if self.store.exists("gold.dim_zone") else None
            change = scd2_apply(current, source, "zone_id", ["borough", "zone_name", "service_zone"], self.now)
            zones = change.counts()
            if current is None or zones["inserted"] or zones["expired"]:
                self.store.overwrite("gold.dim_zone", change.dimension)
        return {"dim_date_rows": days, "dim_zone_scd2": zones}

    def fact(self) -> dict:
        """Adds the clean batches that are not in the fact yet; everything on a full refresh, or if the clean table was written anew."""
        there = self.store.batches(CLEAN)
        done = {r[0] for r in self.store.read(MERGED).collect()} if self.store.exists(MERGED) and self.store.exists(FACT) else set()  # batch names
        new = [b for b in there if b not in done]
        if self.settings.full_refresh or not done or any(b.endswith("/base") for b in new):
            self.store.overwrite(FACT, gold.build_fact(self.store.read(CLEAN)), ["date_key"])
            mode, new = "full", there
        else:
            mode = "incremental_merge"
            for b in new:
                rows = self.store.read_batch(CLEAN, b.split("/", 1)[1])
                self.store.merge_insert(FACT, gold.build_fact(rows), ["trip_hash"], b.replace("/", "-"), "date_key")
        if new:
            self.store.append(MERGED, self.spark.createDataFrame([(b,) for b in new], "batch string"), self.settings.run_id)
        return {"mode": mode, "rows": self.store.count(FACT)}

    def aggregates(self) -> dict:
        fact = self.store.read(FACT)
        if self.store.exists("gold.dim_zone"):
            zones = gold.current_zones(self.store.read("gold.dim_zone"))
        else:
            zones = self.spark.createDataFrame([], "zone_id int, borough string, zone_name string")
        self.store.overwrite(DAILY, gold.mart_daily(fact, zones), ["date_key"])
        self.store.overwrite(MONTHLY, gold.mart_monthly(fact))
        return {"daily_rows": self.store.count(DAILY), "monthly_rows": self.store.count(MONTHLY)}

    def reconciliation(self) -> dict:
        read = self.store.read
        checks = [recon.source_vs_bronze(read(MANIFEST), read(BRONZE)), recon.bronze_vs_silver(self._recovered(read(BRONZE)), read(CLEAN), read(QUARANTINE)),
                  recon.clean_and_quarantined(read(CLEAN), read(QUARANTINE)),
                  recon.rows_equal(read(CLEAN), read(FACT)), recon.amounts_equal(read(CLEAN), read(FACT)), recon.fact_vs_mart(read(FACT), read(DAILY))]
        if not self.store.count(MANIFEST):  # files were put into the folder by hand
            checks = checks[1:]
        return recon.run_recon(checks, self.settings.run_id, self.settings.env, self.now, lambda df: self.store.append(RECON, df), self.fail_on_mismatch)

    def stages(self) -> list[tuple[str, Callable[[], dict]]]:
        return [("ingest_landing", self.ingest_landing), ("bronze_autoload", self.bronze), ("dq_bronze", lambda: self.dq("bronze")),
                ("silver_transform", self.silver), ("dq_silver", lambda: self.dq("silver")), ("gold_dimensions", self.dimensions),
                ("gold_fact", self.fact), ("gold_aggregates", self.aggregates), ("reconciliation", self.reconciliation)]

    def run(self, only: list[str] | None = None) -> dict[str, dict]:
        """Runs the stages in order and returns their metrics; the first failure ends the run."""
        self.setup()
        out = {}
        for name, stage in self.stages():
            if only and name not in only:
                continue
            with audited(self.log, name) as metrics:
                metrics.update(stage())
            out[name] = metrics
        return out




def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Runs the pipeline.")
    p.add_argument("--root", required=True, help="workspace folder")
    p.add_argument("--env", default="dev")
    p.add_argument("--run-month", default="")
    p.add_argument("--full-refresh", default="false")
    p.add_argument("--source", default="", help="URL or path of a month's file; {month} is replaced")
    p.add_argument("--zones", default="", help="URL or path of the zone lookup")
    p.add_argument("--stages", nargs="*")
    a = p.parse_args(args)
    settings = Settings(a.root, a.env, a.run_month, parse_flag(a.full_refresh))
    pipeline = Pipeline(build_session(), settings, (lambda m: a.source.format(month=m)) if a.source else None, zones=a.zones or None)
    for stage, metrics in pipeline.run(a.stages).items():
        print(stage, metrics)


if __name__ == "__main__":
    main()
