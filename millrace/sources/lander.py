"""Landing files: fetch with retries, atomically, once per month, with a manifest."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from millrace.sources.fs import Files
from millrace.store import Store

MANIFEST = "ops.ingest_manifest"
MANIFEST_SCHEMA = ("file_name string, file_path string, run_month string, source string, size_bytes bigint, source_row_count bigint, status string, landed_at timestamp_ntz")
#: Attempts, seconds of pause per attempt, bytes a read, seconds until a read is given up.
ATTEMPTS, PAUSE_S, CHUNK, TIMEOUT_S = 3, 5, 8 << 20, 120


def _blocks(files: Files, source: str) -> Iterator[bytes]:
    """A web address is read over the network, anything else through its file system."""
    if source.startswith(("http://", "https://", "ftp://")):
        with urllib.request.urlopen(source, timeout=TIMEOUT_S) as stream:
            while block := stream.read(CHUNK):
                yield block
    else:
        yield from files.blocks(source, CHUNK)


def fetch(files: Files, source: str, target: str, attempts: int = ATTEMPTS, pause: float = PAUSE_S, blocks: Callable[[Files, str], Iterator[bytes]] = _blocks) -> int:
    """Copies a URL or a path to target and returns its size. Bytes go to `<target>.part`, which is renamed when
    complete, so a broken fetch never leaves a file that a scan picks up. RuntimeError after the last attempt."""
    last: Exception | None = None
    for n in range(1, attempts + 1):
        try:
            with files.writer(f"{target}.part") as write:
                for block in blocks(files, source):
                    write(block)
            files.move(f"{target}.part", target)
            return files.size(target)
        except Exception as e:  # noqa: BLE001
            last = e
            time.sleep(pause * n)
    files.drop(f"{target}.part")
    raise RuntimeError(f"cannot fetch {source} in {attempts} attempts") from last


def land_month(spark: SparkSession, store: Store, landing: str, month: str, source: str, full_refresh: bool = False, **how) -> dict:
    """Lands one monthly file. Skips a month the manifest has as LANDED (unless full_refresh); a file that is already in
    the folder is registered without a fetch."""
    name = f"yellow_tripdata_{month}.parquet"
    target = f"{landing}/{name}"
    store.create(MANIFEST, MANIFEST_SCHEMA)
    done = store.read(MANIFEST).filter(f"file_name = '{name}' AND status = 'LANDED'").limit(1).count()
    if done and not full_refresh:
        return {"file_name": name, "skipped": True, "reason": "already landed"}
    files = Files(spark)
    there = files.exists(target) and not full_refresh
    size = files.size(target) if there else fetch(files, source, target, **how)
    rows = spark.read.parquet(target).count()
    row = (name, target, month, "existing" if there else source, size, rows, "LANDED", datetime.now(timezone.utc).replace(tzinfo=None))
    store.append(MANIFEST, spark.createDataFrame([row], MANIFEST_SCHEMA))
    return {"file_name": name, "size_bytes": size, "source_row_count": rows, "skipped": False}


def land_reference(spark: SparkSession, landing: str, source: str, **how) -> int:
    """Fetches the zone lookup, each time anew."""
    return fetch(Files(spark), source, f"{landing}/taxi_zone_lookup.csv", **how)
