"""Snapshot store, landing, ingest stream, audit and the whole pipeline."""

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string as schema
from test_silver import NAMES, RAW, trip

from millrace.config import Settings, parse_flag
from millrace.ops.audit import RUNS, AuditLog, audited
from millrace.ops.runner import BRONZE, CLEAN, DAILY, FACT, QUARANTINE, Pipeline
from millrace.sources.files import count_rows, csv_snapshot, read_rescued
from millrace.sources.fs import Files
from millrace.sources.lander import fetch, land_month
from millrace.store import SchemaConflict, Store, near
from millrace.streaming.arrivals import load_new_files


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "tables"))


def test_store_versions(store, frame):
    df = frame([(1, "a"), (2, "b")], "k int, v string")
    assert not store.exists("gold.t") and store.version("gold.t") == 0
    store.overwrite("gold.t", df)
    store.overwrite("gold.t", store.read("gold.t").filter("k = 1"), ["k"])  # read while it is replaced
    assert store.count("gold.t") == 1 and store.versions("gold.t") == [1, 2]
    store.restore("gold.t", 1)
    assert store.count("gold.t") == 2
    with pytest.raises(ValueError):
        store.restore("gold.t", 7)
    store.append("gold.t", frame([(3, "c")], "k int, v string"), "b1")
    store.append("gold.t", frame([(3, "c")], "k int, v string"), "b1")  # the same batch again
    store.append("gold.t", frame([(4, "d", 1)], "k int, v string, more int"))
    with pytest.raises(SchemaConflict):
        store.append("gold.t", frame([("x",)], "k string"))
    assert store.count("gold.t") == 4 and "more" in store.read("gold.t").columns
    store.merge_insert("gold.t", frame([(4, "x"), (5, "y")], "k int, v string"), ["k"])
    assert rows(store.read("gold.t"), "k", "v")[-2:] == [(4, "d"), (5, "y")]
    store.compact("gold.t", 1)
    assert store.count("gold.t") == 5 and store.vacuum("gold.t", 1) == [1, 2]
    store.create("gold.t", "k int")
    assert store.count("gold.t") == 5


def test_fetch_retries_and_leaves_no_half_file(spark, tmp_path):
    src = tmp_path / "src"
    src.write_bytes(b"abc" * 1000)
    calls = []

    def flaky(files, s):
        calls.append(s)
        yield b"ab"
        if len(calls) < 3:
            raise OSError("down")

    files = Files(spark)
    assert fetch(files, str(src), str(tmp_path / "out/x"), pause=0, blocks=flaky) == 2 and len(calls) == 3
    assert fetch(files, str(src), str(tmp_path / "out/y")) == 3000 and (tmp_path / "out/y").read_bytes() == src.read_bytes()
    assert fetch(files, src.as_uri(), str(tmp_path / "out/y")) == 3000
    with pytest.raises(RuntimeError):
        fetch(files, str(tmp_path / "absent"), str(tmp_path / "out/z"), pause=0)
    assert files.names(str(tmp_path / "out")) == ["x", "y"] or sorted(f for f in os.listdir(tmp_path / "out") if not f.startswith(".")) == ["x", "y"]


def test_landing_is_idempotent(spark, store, tmp_path, frame):
    frame([(1,), (2,)], "a int").coalesce(1).write.parquet(str(tmp_path / "m"))
    source = str(next((tmp_path / "m").glob("*.parquet")))
    landing = str(tmp_path / "landing")
    assert land_month(spark, store, landing, "2024-01", source)["source_row_count"] == 2
    assert land_month(spark, store, landing, "2024-01", source)["skipped"]
    assert not land_month(spark, store, landing, "2024-01", source, full_refresh=True)["skipped"]
    assert count_rows(spark, landing) == 2


def test_csv(spark, tmp_path):
    (tmp_path / "z.csv").write_text("LocationID,Zone\n1,A\n02,\n")
    df = csv_snapshot(spark, str(tmp_path / "z.csv"))
    assert rows(df, "LocationID", "Zone") == sorted([("1", "A"), ("02", None)], key=repr) and dict(df.dtypes)["LocationID"] == "string"


def test_rescue_of_drifting_files(spark, tmp_path, frame):
    frame([(1, 2.0, "a")], "id int, x double, s string").coalesce(1).write.parquet(str(tmp_path / "a"))
    frame([(2**40, "7", "b", 5)], "id bigint, x string, S string, extra int").coalesce(1).write.parquet(str(tmp_path / "b"))
    files = sorted(str(p) for d in "ab" for p in (tmp_path / d).glob("*.parquet"))
    df = read_rescued(spark, files, schema("id int, x double, s string"))
    assert df.columns == ["id", "x", "s", "_source_file", "_rescued_data"]
    got = df.filter("_rescued_data is not null").select("id", "x", "s", *[F.get_json_object("_rescued_data", f"$.{k}").alias(f"r_{k}") for k in ("id", "x", "S", "extra")]).collect()
    assert [tuple(r) for r in got] == [(None, None, None, str(2**40), "7", "b", "5")]
    assert read_rescued(spark, [], schema("id int")).count() == 0


def test_stream_sees_each_file_once_and_no_part_files(spark, store, tmp_path, frame):
    landing = tmp_path / "landing"
    landing.mkdir()

    def put(name, data, ddl):
        frame(data, ddl).coalesce(1).write.parquet(str(tmp_path / f"w-{name}"))
        os.replace(next((tmp_path / f"w-{name}").glob("*.parquet")), landing / name)

    put("a.parquet", [(1,)], "id int")
    (landing / "b.parquet.part").write_bytes(b"junk")
    load = lambda: load_new_files(spark, store, str(landing), "bronze.t", schema("id int"), str(tmp_path / "ck"))
    assert load() == 1 and load() == 1
    put("c.parquet", [(2,), (3,)], "id bigint")
    assert load() == 3
    assert rows(store.read("bronze.t"), "id", "_source_file") == [(1, "a.parquet"), (2, "c.parquet"), (3, "c.parquet")]


def test_audit(store, tmp_path):
    log = AuditLog(store, Settings(str(tmp_path), run_id="r1"))
    with audited(log, "good") as m:
        m["n"] = 3
    with pytest.raises(ValueError):
        with audited(log, "bad"):
            raise ValueError("x" * 5000)
    got = store.read(RUNS).orderBy("logged_at").collect()
    assert [(r.task_name, r.status) for r in got] == [("good", "RUNNING"), ("good", "SUCCESS"), ("bad", "RUNNING"), ("bad", "FAILED")]
    assert got[1].metrics == '{"n": 3}' and got[3].error.startswith("ValueError: xxx") and len(got[3].error) == 4000


def test_settings():
    assert parse_flag("TRUE") and not parse_flag("") and not parse_flag(None)
    with pytest.raises(ValueError):
        Settings("/x", "nowhere")


def test_two_batches_end_to_end(spark, tmp_path, frame):
    lookup = tmp_path / "lookup.csv"
    lookup.write_text("LocationID,Borough,Zone,service_zone\n" + "\n".join(f"{i},B,Z{i},S" for i in range(1, 300)) + "\n")
    raw = RAW.rsplit(", _ingested_at", 1)[0]
    months = {
        "2024-01": [trip(VendorID=i % 3, total_amount=10.0 + i) for i in range(40)] + [trip(VendorID=9, passenger_count=30)],
        "2024-02": [trip(VendorID=i % 3, total_amount=30.0 + i) for i in range(40)] + [trip(VendorID=8, trip_distance=-1.0), trip(VendorID=4, total_amount=77.0), trip(VendorID=4, total_amount=77.0)],
    }
    for m, data in months.items():
        frame([r[: len(NAMES) - 2] for r in data], raw).coalesce(1).write.parquet(str(tmp_path / m))

    def source(m):
        return str(next((tmp_path / m).glob("*.parquet")))

    def run(month, full=False):
        return Pipeline(spark, Settings(str(tmp_path / "ws"), run_month=month, full_refresh=full), source, "2024-03-01 00:00:00", zones=str(lookup)).run()

    one = run("2024-01")
    assert one["silver_transform"] == {"rows_in": 41, "rows_clean": 40, "rows_quarantined": 1, "skipped": False} and one["gold_fact"]["mode"] == "full"
    two = run("2024-02")
    store = Store(spark, str(tmp_path / "ws/dev/tables"))
    assert two["silver_transform"]["rows_quarantined"] == 1 and two["gold_fact"]["mode"] == "incremental_merge"
    assert two["gold_dimensions"]["dim_zone_scd2"] == {"inserted": 0, "expired": 0} and two["reconciliation"]["failed"] == 0
    counts = {t: store.count(t) for t in (BRONZE, CLEAN, QUARANTINE, FACT, DAILY)}
    again = run("2024-02")
    assert again["ingest_landing"]["skipped"] and again["silver_transform"]["skipped"]
    assert {t: store.count(t) for t in counts} == counts
    hashes = lambda t: {r.trip_hash for r in store.read(t).select("trip_hash").collect()}
    assert not hashes(CLEAN) & hashes(QUARANTINE) and len(hashes(CLEAN)) == counts[CLEAN] == counts[FACT]
    before = hashes(CLEAN) | hashes(QUARANTINE)
    run("2024-02", full=True)
    assert hashes(CLEAN) | hashes(QUARANTINE) == before


def test_merge_reads_only_the_range_of_the_stage(store, frame):
    ddl = "k string, d date"
    store.overwrite("t.x", frame([("a", "2024-01-01"), ("b", "2024-01-05"), ("n", None)], ddl), ["d"])
    store.merge_insert("t.x", frame([("b", "2024-01-05"), ("c", "2024-01-06"), ("n", None)], ddl), ["k"], "b1", "d")
    assert rows(store.read("t.x"), "k") == [("a",), ("b",), ("c",), ("n",)]
    store.merge_insert("t.x", frame([("n", None)], ddl), ["k"], "b2", "d")
    assert store.count("t.x") == 4


def test_a_wrong_clock_does_not_widen_the_merge(store, frame):
    ddl = "k string, d date, n int"
    days = [("a", "2024-01-05", 1), ("b", "2024-01-06", 1), ("c", "2091-03-01", 1)]
    t = frame([("x", "2024-01-05", 1), ("y", "2030-01-01", 1), ("z", "2091-03-01", 1), ("n", None, 1)], ddl)
    assert rows(t.filter(near(frame(days, ddl), "d")), "k") == [("x",), ("z",)]
    assert rows(t.filter(near(frame([*days, ("d", None, 1)], ddl), "d")), "k") == [("n",), ("x",), ("z",)]
    assert t.filter(near(frame([], ddl), "d")).count() == 0
    many = frame([(str(i), None, i * 7) for i in range(100)], ddl)
    assert many.filter(near(many, "n")).count() == 100


def test_rescued_values_reach_silver_and_keys_stand_in_one_table(spark, tmp_path, frame):
    raw = RAW.rsplit(", _ingested_at", 1)[0]
    one = [trip(VendorID=i % 3, total_amount=10.0 + i)[: len(NAMES) - 2] for i in range(30)]
    frame(one, raw).coalesce(1).write.parquet(str(tmp_path / "2024-01"))
    # the next file spells a column differently, gives another as text, and holds ride 0 again, now broken
    two = [trip(VendorID=i % 3, total_amount=50.0 + i)[: len(NAMES) - 2] for i in range(20)] + [trip(VendorID=0, total_amount=10.0, trip_distance=-1.0)[: len(NAMES) - 2]]
    df = frame(two, raw).withColumnRenamed("PULocationID", "pulocationid").withColumn("trip_distance", F.col("trip_distance").cast("string"))
    df.coalesce(1).write.parquet(str(tmp_path / "2024-02"))

    def run(month):
        source = lambda m: str(next((tmp_path / m).glob("*.parquet")))
        return Pipeline(spark, Settings(str(tmp_path / "ws"), run_month=month), source, "2024-03-01 00:00:00").run(
            ["ingest_landing", "bronze_autoload", "silver_transform", "gold_fact", "gold_aggregates", "reconciliation"])

    run("2024-01")
    got = run("2024-02")
    assert got["silver_transform"] == {"rows_in": 21, "rows_clean": 20, "rows_quarantined": 1, "skipped": False}
    assert got["gold_fact"] == {"mode": "incremental_merge", "rows": 50} and got["reconciliation"]["failed"] == 0
    store = Store(spark, str(tmp_path / "ws/dev/tables"))
    assert store.count(CLEAN) == 50 and store.count(QUARANTINE) == 0  # ride 0 is clean already
    assert store.read(CLEAN).filter("pickup_zone_id IS NULL OR trip_distance IS NULL").isEmpty()


def test_command_line(spark, tmp_path, frame, capsys):
    from millrace.ops.runner import main

    raw = RAW.rsplit(", _ingested_at", 1)[0]
    frame([trip(VendorID=i)[: len(NAMES) - 2] for i in range(5)], raw).coalesce(1).write.parquet(str(tmp_path / "m"))
    (tmp_path / "z.csv").write_text("LocationID,Borough,Zone,service_zone\n" + "\n".join(f"{i},B,Z,S" for i in range(300)) + "\n")
    os.replace(next((tmp_path / "m").glob("*.parquet")), tmp_path / "2024-01.parquet")
    main(["--root", str(tmp_path / "ws"), "--run-month", "2024-01", "--source", str(tmp_path) + "/{month}.parquet", "--zones", str(tmp_path / "z.csv"), "--stages", "ingest_landing", "bronze_autoload", "dq_bronze"])
    assert "'rules_failed': 0" in capsys.readouterr().out
