"""Versioned snapshot tables on plain Parquet.

A table is a folder of versions and a log. Each log entry names the current version and the table's
schema; entries are only ever added, by renaming a finished file, so readers never see half a change,
a table may be read while it is replaced, and earlier versions can be restored. Appends write a batch
folder inside the current version under a name of their own; repeating a batch replaces it. Since the
log holds the schema, a read opens no footers to find it. One writer per table is assumed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators.merge import new_rows, require_unique


class SchemaConflict(ValueError):
    """A batch gives a column another type."""


def merged(have: StructType, more: StructType) -> StructType:
    """have, then the fields that only more has; all nullable."""
    kinds = {f.name.lower(): f.dataType for f in have.fields}
    for f in more.fields:
        if kinds.get(f.name.lower(), f.dataType) != f.dataType:
            raise SchemaConflict(f"{f.name} is {kinds[f.name.lower()].simpleString()}, not {f.dataType.simpleString()}")
    out = StructType()
    for f in [*have.fields, *(f for f in more.fields if f.name.lower() not in kinds)]:
        out = out.add(f.name, f.dataType, True)
    return out


#: Ranges in which the values of a stage are summed up at most, and values beyond which they are not looked at one by one.
MOST_RANGES, MOST_VALUES = 32, 100_000


def near(stage: DataFrame, column: str) -> Column:
    """A condition on a column (dates or whole numbers) that holds for every value that the stage has: a few ranges, which scans
    can skip by; null if the stage has nulls."""
    values = [r[0] for r in stage.select(column).distinct().limit(MOST_VALUES + 1).collect()]
    c, out = F.col(column), F.lit(False)
    if None in values:
        out = c.isNull()
    known = sorted(v for v in values if v is not None)
    if len(values) > MOST_VALUES:
        return F.lit(True)
    number = (lambda v: v.toordinal()) if known and hasattr(known[0], "toordinal") else (lambda v: v)
    wide = sorted(sorted(range(1, len(known)), key=lambda i: number(known[i - 1]) - number(known[i]))[: MOST_RANGES - 1])
    breaks = [i for i in wide if number(known[i]) - number(known[i - 1]) > 1]
    for i, j in zip([0, *breaks], [*breaks, len(known)]):
        if i < j:
            out = out | c.between(F.lit(known[i]), F.lit(known[j - 1]))
    return out


class Store:
    """Tables named `layer.table` under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _dir(self, name: str) -> str:
        return f"{self.root}/{name.replace('.', '/')}"

    def _names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _entries(self, name: str) -> list[str]:
        return [x for x in self._names(f"{self._dir(name)}/_log") if x.isdigit()]

    def _entry(self, name: str) -> dict | None:
        entries = self._entries(name)
        if not entries:
            return None
        stream = self._fs.open(self._path(f"{self._dir(name)}/_log/{entries[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _record(self, name: str, version: int, schema: StructType) -> None:
        entries = self._entries(name)
        number = int(entries[-1]) + 1 if entries else 1
        tmp = self._path(f"{self._dir(name)}/_log/next-{uuid.uuid4().hex}")
        out = self._fs.create(tmp, True)
        try:
            out.write(json.dumps({"version": version, "schema": schema.jsonValue()}).encode())
        finally:
            out.close()
        if not self._fs.rename(tmp, self._path(f"{self._dir(name)}/_log/{number:010d}")):
            raise OSError(f"another writer changed {name}")

    def exists(self, name: str) -> bool:
        return bool(self._entries(name))

    def version(self, name: str) -> int:
        """The current version, 0 if there is no table."""
        entry = self._entry(name)
        return entry["version"] if entry else 0

    def versions(self, name: str) -> list[int]:
        return sorted(int(x[1:]) for x in self._names(self._dir(name)) if x.startswith("v"))

    def schema(self, name: str) -> StructType:
        entry = self._entry(name)
        if entry is None:
            raise ValueError(f"there is no table {name}")
        return StructType.fromJson(entry["schema"])

    def read(self, name: str) -> DataFrame:
        """The current rows; columns that a batch lacks are null."""
        entry = self._entry(name)
        if entry is None:
            raise ValueError(f"there is no table {name}")
        return self.spark.read.schema(StructType.fromJson(entry["schema"])).option("recursiveFileLookup", True).parquet(f"{self._dir(name)}/v{entry['version']}")

    def read_batch(self, name: str, batch: str) -> DataFrame:
        """The rows of one batch that was appended to the current version."""
        entry = self._entry(name)
        if entry is None:
            raise ValueError(f"there is no table {name}")
        return self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(f"{self._dir(name)}/v{entry['version']}/b-{batch}")

    def overwrite(self, name: str, df: DataFrame, cluster_by: list[str] | None = None) -> int:
        """Writes df as a new version; it may be computed from the current one. cluster_by keeps ranges of these columns
        together, so that scans skip files and row groups."""
        v = max([0, *self.versions(name)]) + 1
        if cluster_by:
            df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
        df.write.mode("overwrite").parquet(f"{self._dir(name)}/v{v}/base")
        self._record(name, v, merged(StructType(), df.schema))
        return v

    def append(self, name: str, df: DataFrame, batch: str | None = None) -> None:
        """Adds df as one batch; a batch of the same name is replaced, so a repeated write adds nothing twice."""
        have = self.exists(name)
        v = self.version(name) if have else max([0, *self.versions(name)]) + 1
        before = self.schema(name) if have else StructType()
        after = merged(before, df.schema)
        df.write.mode("overwrite").parquet(f"{self._dir(name)}/v{v}/b-{batch or uuid.uuid4().hex}")
        if not have or after != before:
            self._record(name, v, after)

    def merge_insert(self, name: str, stage: DataFrame, key: list[str], batch: str | None = None, within: str | None = None) -> None:
        """Appends the stage's rows whose key is new. The stage must not repeat a key.

        `within` names a column that the key determines (a date of a time in the key, or its number): only target
        rows with a value that the stage has, or near one, are compared, so with a clustered target the merge reads
        the stage's days and not the table, also where a few rows with a wrong clock lie years off.
        """
        require_unique(stage, key)
        if not self.exists(name):
            return self.append(name, stage, batch)
        target = self.read(name)
        return self.append(name, new_rows(target.filter(near(stage, within)) if within else target, stage, key), batch)

    def batches(self, name: str) -> list[str]:
        """What the current version was made of: `base` and the appended batches, each as version/batch."""
        v = self.version(name)
        return [f"{v}/{x.removeprefix('b-')}" for x in self._names(f"{self._dir(name)}/v{v}")]

    def restore(self, name: str, version: int) -> None:
        if version not in self.versions(name):
            raise ValueError(f"{name} has no version {version}")
        df = self.spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(f"{self._dir(name)}/v{version}")
        self._record(name, version, df.schema)

    def compact(self, name: str, files: int | None = None, cluster_by: list[str] | None = None) -> int:
        """Rewrites the current version, batches and all, into few files."""
        df = self.read(name)
        return self.overwrite(name, df if cluster_by else df.repartition(files) if files else df.repartition(), cluster_by)

    def vacuum(self, name: str, keep: int = 2) -> list[int]:
        """Drops versions older than the last `keep`, never the current one, and log entries but the last."""
        now, gone = self.version(name), []
        for v in self.versions(name)[:-keep] if keep else self.versions(name):
            if v != now:
                self._fs.delete(self._path(f"{self._dir(name)}/v{v}"), True)
                gone.append(v)
        for x in self._entries(name)[:-1]:
            self._fs.delete(self._path(f"{self._dir(name)}/_log/{x}"), False)
        return gone

    def create(self, name: str, ddl: str) -> None:
        """An empty table, if there is none."""
        if not self.exists(name):
            self.overwrite(name, self.spark.createDataFrame([], ddl))

    def count(self, name: str) -> int:
        return self.read(name).agg(F.count("*")).first()[0]
