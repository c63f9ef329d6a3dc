"""Incremental file ingest: a bounded stream discovers new files exactly once and adds them to a table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.sources.files import read_rescued
from millrace.store import Store


_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def load_new_files(spark: SparkSession, store: Store, landing: str, table: str, tracked: StructType, checkpoint: str, pattern: str = "*.parquet", files: str | None = None) -> int:
    """Adds every file of the landing folder that was not seen before; returns the table's rows. `files` names a table
    that gets the names of the files, so that later steps find new ones without a scan of the rows.

    The stream reads names and paths only (the file-arrival source with `availableNow`), so files of
    any schema pass; each micro-batch reads its files under the tracked schema, leftovers rescued. A
    batch is written under a digest of its files, so a repeated batch replaces itself. Half-written
    `*.part` files do not match the pattern.
    """
    names = (spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", pattern).load(landing).select("path", "length"))

    def add(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.select("path").collect()]  # file names of one micro-batch
        if paths:
            rows = read_rescued(spark, sorted(paths), tracked).withColumn("_ingested_at", F.current_timestamp().cast("timestamp_ntz"))
            batch_name = "files-" + hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:32]
            store.append(table, rows, batch_name)
            if files:
                store.append(files, spark.createDataFrame([(p.rsplit("/", 1)[-1],) for p in paths], "_source_file string"), batch_name)

    query = names.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return store.count(table) if store.exists(table) else 0
