"""Reading landed files: CSV snapshots, row counts, and Parquet files of drifting schemas with rescued data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators.drift import schemas_of


def csv_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every column as text, stamped with the load time."""
    return spark.read.option("header", True).csv(path).withColumn("_ingested_at", F.current_timestamp().cast("timestamp_ntz"))


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows of Parquet files, from their footers."""
    return spark.read.parquet(path).count()


def with_lineage(df: DataFrame) -> DataFrame:
    """Adds the name of the file each row came from."""
    return df.withColumn("_source_file", F.col("_metadata.file_name"))


def conform(df: DataFrame, tracked: StructType, file_path: Column, rescued: str = "_rescued_data") -> DataFrame:
    """df's rows under the tracked schema. A column fits by name (case counts); a value fits if it can be read as the
    tracked type without loss. What does not fit stands in the rescued JSON under its own name, with the file's path."""
    have = {f.name: f for f in df.schema.fields}
    out, rest = [], []
    for f in tracked.fields:
        if f.name not in have:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c, kind = F.col(f"`{f.name}`"), have[f.name].dataType
        if kind == f.dataType:
            out.append(c)
            continue
        v = c.try_cast(f.dataType)
        lossless = v.isNotNull() & v.try_cast(kind).eqNullSafe(c) if kind.typeName() not in ("string",) else F.lit(False)
        out.append(F.when(lossless, v).alias(f.name))
        rest.append(F.when(~lossless, c).alias(f.name))
    names = {f.name for f in tracked.fields}
    rest += [F.col(f"`{f.name}`") for f in df.schema.fields if f.name not in names and f.name != "_file_path"]
    if rest:
        some = F.coalesce(*[F.when(c.isNotNull(), F.lit(1)) for c in rest])
        out.append(F.when(some.isNotNull(), F.to_json(F.struct(*rest, file_path.alias("_file_path")))).alias(rescued))
    else:
        out.append(F.lit(None).cast("string").alias(rescued))
    return df.select(*out)


def read_rescued(spark: SparkSession, paths: list[str], tracked: StructType, rescued: str = "_rescued_data") -> DataFrame:
    """Parquet files of differing schemas as one frame of the tracked schema.

    Files are grouped by schema, and each group is one scan, so the number of scans grows with the
    number of schemas, not of files.
    """
    groups: dict[str, list[str]] = {}
    for p, found in zip(paths, schemas_of(spark, paths)):
        groups.setdefault(found.json(), []).append(p)
    out = None
    for files in groups.values():
        df = spark.read.parquet(*files).withColumns({"_source_file": F.col("_metadata.file_name"), "_file_path": F.col("_metadata.file_path")})
        part = conform(df, StructType([*tracked.fields, df.schema["_source_file"]]), F.col("_file_path"), rescued)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], tracked).withColumns({"_source_file": F.lit(None).cast("string"), rescued: F.lit(None).cast("string")})
    return out
