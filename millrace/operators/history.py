"""History of changing entity attributes from periodic snapshots.

Each snapshot is compared with the one before it by a null-safe full outer join that classifies
every key as inserted, changed, deleted or the same; the change events alone make the history.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import Scratch, bounded_broadcast

#: Attributes and arrivals travel as numbers if snapshots hold at most so many different ones, counted in each and added up.
CODED = 100_000
#: Rows per key and snapshot (estimated) from which on repeats are dropped before rows are gathered by key.
REPEATS = 1.25


def latest_per_snapshot(df: DataFrame, snapshot: str, key: str, attributes: list[str], arrived: str) -> DataFrame:
    """One row per (snapshot, key): the one that arrived last, ties by attributes; partial aggregation, no window."""
    best = F.max(F.struct(F.col(arrived), *attributes)).alias("_w")
    return df.filter(F.col(key).isNotNull() & F.col(snapshot).isNotNull()).groupBy(snapshot, key).agg(best).select(
        snapshot, key, *[F.col(f"_w.{a}").alias(a) for a in attributes])


def change_events(snapshots: DataFrame, snapshot: str, key: str, attributes: list[str], days: DataFrame | None = None, keyed: bool = False) -> DataFrame:
    """(snapshot, key, attributes, change) for every key that differs from the snapshot before.

    snapshots must hold one row per (snapshot, key). A deleted key carries the day it was first
    absent and null attributes. Ordering the snapshots sorts their distinct dates only; days is
    their table, if there is one. keyed says that no key is null; rows that are partitioned by key
    are then compared where they are.
    """
    days = snapshots.select(snapshot).distinct() if days is None else days
    following = bounded_broadcast(days.filter(F.col(snapshot).isNotNull()).select(snapshot, F.lead(snapshot).over(Window.orderBy(snapshot)).alias("_next")))
    cur = snapshots.filter(F.col(snapshot).isNotNull()).select(F.col(snapshot).alias("day"), F.col(key).alias("k"), F.struct(*attributes).alias("cur"))
    # keys of the last snapshot have no day on which they could be missed
    prev = snapshots.join(following, snapshot).filter("_next IS NOT NULL").select(F.col("_next").alias("pday"), F.col(key).alias("pk"), F.struct(*attributes).alias("prev"))
    same = F.col("k") == F.col("pk") if keyed else F.col("k").eqNullSafe(F.col("pk"))
    both = cur.join(prev, same & (F.col("day") == F.col("pday")), "full_outer")
    change = (F.when(F.col("pday").isNull(), "inserted").when(F.col("day").isNull(), "deleted")
              .when(~F.col("cur").eqNullSafe(F.col("prev")), "changed"))
    return both.withColumn("change", change).filter("change IS NOT NULL").select(
        F.coalesce("day", "pday").alias(snapshot), F.coalesce("k", "pk").alias(key), *[F.col(f"cur.{a}").alias(a) for a in attributes], "change")


def build_history(snapshots: DataFrame, snapshot: str, key: str, attributes: list[str]) -> DataFrame:
    """(key, attributes, valid_from, valid_to): validity is half-open, null valid_to means still valid.

    A key that is absent and comes back starts a new version. An empty input gives no rows.
    """
    return _versions(change_events(snapshots, snapshot, key, attributes), snapshot, key, attributes)


def _versions(events: DataFrame, snapshot: str, key: str, attributes: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(snapshot)
    return events.withColumn("valid_to", F.lead(snapshot).over(w)).filter("change <> 'deleted'").select(
        key, *attributes, F.col(snapshot).alias("valid_from"), "valid_to")


@contextlib.contextmanager
def _join_in_place(spark: SparkSession) -> Iterator[None]:
    """What is executed inside the block joins rows where they are if they are partitioned by one of the join's keys."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Snapshots:
    """Rows of all snapshots, repeated and late ones too, of which changes and history are made with one shuffle of the rows.

    What latest_per_snapshot and the functions on its result give, for the same nulls, ties and repeated rows. Rows
    are gathered by key, which serves the latest row as well as the comparison. Where attributes and arrivals are few
    they are numbered in their order, and rows travel with one number for both; where keys repeat within snapshots,
    repeats are combined before rows travel. clean is applied to each attribute; nothing else of the row may decide it.
    """

    def __init__(self, df: DataFrame, snapshot: str, key: str, attributes: list[str], arrived: str, clean: Callable[[Column], Column] = lambda c: c):
        self.snapshot, self.key, self.attributes, self.clean = snapshot, key, attributes, clean
        self.scratch, self.names = Scratch(df.sparkSession, "history"), None
        df = df.select(snapshot, key, *attributes, F.col(arrived).alias("_arrived"))
        rows = df.filter(F.col(key).isNotNull() & F.col(snapshot).isNotNull())
        few = [F.approx_count_distinct(c).alias(n) for n, c in (("_keys", F.col(key)), ("_kinds", F.struct(*attributes)), ("_arrivals", F.col("_arrived")))]
        self.days = self.scratch.write(rows.groupBy(snapshot).agg(F.count("*").alias("_n"), *few), "days")
        got = self.days.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("_n", "_keys", "_kinds", "_arrivals")]).first()
        coded = self._coded(df, rows) if max(got._kinds, got._arrivals) <= CODED else None
        if coded is None:
            coded = rows.select(snapshot, key, F.struct("_arrived", *[clean(F.col(a)).alias(a) for a in attributes]).alias("_last"))
        best = F.max("_last").alias("_last")
        if got._n > REPEATS * got._keys:
            coded = coded.groupBy(snapshot, key).agg(best)
        last = coded.repartition(key).groupBy(snapshot, key).agg(best)
        self.carried = attributes if self.names is None else ["_code"]
        self.latest = last.select(snapshot, key, *([F.col(f"_last.{a}").alias(a) for a in attributes] if self.names is None else [F.col("_last").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("_code")]))

    def _coded(self, df: DataFrame, rows: DataFrame) -> DataFrame | None:
        """rows with the numbers of arrival and attributes in one; both are in the order of what they stand for. None if a table of numbers is too large."""
        number = lambda *by: F.dense_rank().over(Window.orderBy(*by))
        cleaned = [self.clean(F.col(a)).alias(f"_c{i}") for i, a in enumerate(self.attributes)]
        kinds = df.select(*self.attributes).distinct().select(*self.attributes, *cleaned)
        kinds = self.scratch.write(kinds.withColumn("_code", number(*[f"_c{i}" for i in range(len(cleaned))])), "kinds")
        times = self.scratch.write(df.select("_arrived").distinct().select("_arrived", number("_arrived").alias("_time")), "times")
        few_kinds, few_times = bounded_broadcast(kinds), bounded_broadcast(times)
        if few_kinds is kinds or few_times is times:
            return None
        self.names = F.broadcast(kinds.select("_code", *[F.col(f"_c{i}").alias(a) for i, a in enumerate(self.attributes)]).distinct())
        for small, on in ((few_kinds, self.attributes), (few_times, ["_arrived"])):
            small = small.withColumnsRenamed({c: f"_of_{c}" for c in on})
            same = F.lit(True)
            for c in on:
                same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
            rows = rows.join(small, same)
        return rows.select(self.snapshot, self.key, (F.shiftleft(F.col("_time").cast("bigint"), 32) + F.col("_code")).alias("_last"))

    def _events(self) -> DataFrame:
        with _join_in_place(self.days.sparkSession):
            return self.scratch.write(change_events(self.latest, self.snapshot, self.key, self.carried, self.days, True), "events")

    def _named(self, df: DataFrame) -> DataFrame:
        """df with attributes instead of their number; those of a deleted key are null."""
        return df if self.names is None else df.join(self.names, "_code", "left")

    def changes(self) -> DataFrame:
        """See change_events."""
        return self._named(self._events()).select(self.snapshot, self.key, *self.attributes, "change")

    def history(self) -> DataFrame:
        """See build_history."""
        h = _versions(self._events(), self.snapshot, self.key, self.carried)
        return self._named(h).select(self.key, *self.attributes, "valid_from", "valid_to")
