"""Session settings, the shared scratch folder, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: A side is broadcast only if it was counted and holds no more rows than this.
BROADCAST_ROWS = 200_000
#: ... and takes no more megabytes than this.
BROADCAST_MB = 128

PINNED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the pinned settings; partition sizes are left to AQE, the master to the launcher."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**PINNED, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session gets a temporary one; a cluster is refused."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive the loss of any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        w = df.write.mode("overwrite")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Removes one table, or all of them; a session that is already gone is no error."""
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:
            pass


def _width(kind: DataType) -> int:
    """Bytes that a value takes in a hash relation besides its text, generously."""
    if isinstance(kind, StructType):
        return 16 + sum(_width(f.dataType) for f in kind.fields)
    if isinstance(kind, (ArrayType, MapType)):
        return 256
    return 24 if isinstance(kind, (StringType, BinaryType)) else 16


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is measured to be small, else df as it is (Catalyst then shuffles).

    Small means at most `rows` rows and BROADCAST_MB megabytes, text counted by its length. The
    measurement is one aggregation, combined where the rows are; give it a materialised or cheap frame.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, (StringType, BinaryType))]
    length = F.lit(0)
    for t in texts:
        length = length + F.coalesce(F.octet_length(F.col(f"`{t}`")), F.lit(0))
    got = df.agg(F.count("*").alias("n"), F.sum(length).alias("b")).first()
    size = got.n * (32 + sum(_width(f.dataType) for f in df.schema.fields)) + (got.b or 0)
    return F.broadcast(df) if got.n <= rows and size <= BROADCAST_MB << 20 else df


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per context, so that functions that run there can be loaded
    wherever the driver was started. Does nothing where the package already came as a file."""
    sc, home = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(sc, "_millrace_shipped", False) or not home.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="millrace-package-")) / "millrace_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f"{home.name}/{f.relative_to(home)}")
    sc.addPyFile(str(target))
    sc._millrace_shipped = True


#: Rows of an Arrow batch where rows hold whole texts, so that a batch of long texts fits a Python worker.
TEXT_BATCH = 512


@contextlib.contextmanager
def text_batches(spark: SparkSession, rows: int = TEXT_BATCH) -> Iterator[None]:
    """Smaller Arrow batches for what is executed inside the block; the session's setting is put back after it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")
