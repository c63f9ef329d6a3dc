"""Attributes as known at event time: dyadic decomposition of validity intervals.

A version valid over [from, to) is resolved against overlapping versions of its key and cut into
dyadic time nodes (level l, index n covers the hours [n*2^l, (n+1)*2^l)). An event lies in exactly
one node per level, so "which version was valid then" is an equi-join on (key, level, node), never
a range join. The exact half-open test runs on the joined row.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.times import epoch_hours
from millrace.session import Scratch, bounded_broadcast


@dataclass(frozen=True)
class Versions:
    """Where a versioned table keeps its parts. version: the column that breaks ties, largest first."""

    key: str
    start: str
    end: str
    version: str


def _nodes(df: DataFrame, lo: Column, hi: Column, levels: int) -> DataFrame:
    """One row per dyadic node of the cell range [lo, hi): at most two a level."""
    at = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    df = df.withColumns({"_lo": lo, "_hi": hi}).withColumn("_lvl", at)
    df = df.withColumns({
        "_a": F.expr("CAST(ceil(_lo / CAST(shiftleft(1L, _lvl) AS DOUBLE)) AS BIGINT)"),
        "_b": F.expr("shiftright(_hi, _lvl)"),
    })
    top = F.col("_lvl") == levels
    # at the top level every whole node is kept; below it only nodes whose parent is not covered
    picks = F.when(top & (F.col("_a") < F.col("_b")), F.sequence("_a", F.col("_b") - 1)).when(
        ~top,
        F.array_compact(F.array(
            F.when((F.col("_a") < F.col("_b")) & (F.col("_a") % 2 != 0), F.col("_a")),
            F.when((F.col("_a") < F.col("_b")) & (F.col("_b") % 2 != 0), F.col("_b") - 1),
        )),
    )
    return df.withColumn("_node", F.explode(picks)).drop("_lo", "_hi", "_a", "_b")


class AsOf:
    """As-of lookup into a versioned table.

    Defined results: versions without key or start, and empty ones (end <= start), are never valid; a
    null end means open; of several valid versions the latest start wins, then the largest version
    column; repeated rows count once. Events with a null key or time, or of an unknown key, match no
    version. An empty version table matches nothing.
    """

    def __init__(self, versions: DataFrame, cols: Versions, attributes: list[str], scratch: Scratch | None = None):
        self.cols, self.attributes = cols, attributes
        self.scratch = scratch or Scratch(versions.sparkSession, "asof")
        k, s, e, v = cols.key, cols.start, cols.end, cols.version
        # the frame is reduced to private names first, so extra columns cannot clash
        base = versions.select(
            F.col(k).alias("_k"), F.col(s).alias("_s"),
            F.col(e).alias("_e"),
            F.col(v).alias("_v"), F.struct(*attributes).alias("_attr"),
        ).filter("_k IS NOT NULL AND _s IS NOT NULL")
        self.base = base.groupBy("_k", "_s", "_e", "_v").agg(F.max("_attr").alias("_attr"))
        live = self.base.filter("_e IS NULL OR _s < _e")
        span = live.agg(
            F.min(epoch_hours("_s")).alias("lo"),
            F.max(F.greatest(epoch_hours("_s"), epoch_hours("_e"))).alias("hi"),
        ).first()
        self.lo, self.hi = (span.lo, span.hi + 1) if span.lo is not None else (0, 1)
        self.levels = max(1, (self.hi - self.lo + 2).bit_length())
        self._segments = self.scratch.write(self._resolve(live), "segments")

    def _cell(self, ts: Column) -> Column:
        """Hours since the first start, clamped: all times before it share cell 0, all after the last boundary the last cell."""
        return F.least(F.greatest(epoch_hours(ts) - F.lit(self.lo - 1), F.lit(0)), F.lit(self.hi - self.lo + 1)).cast("bigint")

    def _cut(self, df: DataFrame) -> DataFrame:
        """df(_s, _e, ...) with its nodes; a null _s is since ever, a null _e until further notice. A cell that is only partly
        covered counts as covered, the exact test decides."""
        first = F.when(F.col("_s").isNull(), F.lit(0)).otherwise(self._cell(F.col("_s"))).cast("bigint")
        last = F.when(F.col("_e").isNull(), F.lit(self.hi - self.lo + 1)).otherwise(
            self._cell(F.expr("_e - INTERVAL '0.000001' SECOND")))
        return _nodes(df, first, (last + 1).cast("bigint"), self.levels)

    def _enclosing(self, ts: Column, levels: list[int]) -> Column:
        cell = self._cell(ts)
        return F.explode(F.array(*[F.struct(F.lit(i).alias("_lvl"), F.shiftright(cell, i).alias("_node")) for i in levels]))

    def _resolve(self, live: DataFrame) -> DataFrame:
        """Disjoint segments per key over all time, the winner's version and attributes or nulls in gaps. The first one of a
        key has no start, the last one no end, so no time of an event lies outside of them."""
        ends = live.filter("_e IS NOT NULL").select("_k", F.col("_e"))
        points = live.select("_k", F.col("_s").alias("_p")).union(ends).union(live.select("_k", F.lit(None).cast("timestamp_ntz"))).distinct()
        nodes = self._cut(live)
        hits = points.filter("_p IS NOT NULL").withColumn("_n", self._enclosing(F.col("_p"), list(range(self.levels + 1)))).select("_k", "_p", "_n._lvl", "_n._node").join(
            nodes, ["_k", "_lvl", "_node"]).filter("_s <= _p AND (_e IS NULL OR _p < _e)")
        winner = hits.groupBy("_k", "_p").agg(F.max(F.struct("_s", "_v", "_attr")).alias("_w"))
        w = Window.partitionBy("_k").orderBy(F.asc_nulls_first("_p"))
        return points.join(winner, ["_k", "_p"], "left").select(
            "_k", F.col("_p").alias("_s"), F.lead("_p").over(w).alias("_e"),
            F.col("_w._v").alias("_v"), F.col("_w._attr").alias("_attr"), F.col("_w").isNotNull().alias("_valid"),
        )

    def segments(self, valid: bool | None = None) -> DataFrame:
        s = self._segments
        return s if valid is None else s.filter(F.col("_valid") == valid)

    def newest(self) -> DataFrame:
        """(_k, _newest): the version with the latest start of all, valid or not."""
        return self.base.groupBy("_k").agg(F.max(F.struct("_s", "_v")).alias("_w")).select("_k", F.col("_w._v").alias("_newest"))

    def matched(self, events: DataFrame, key: str, ts: str, segments: DataFrame | None = None) -> DataFrame:
        """The events that lie in one of the segments, each once, with the segment's columns.

        No shuffle while the node table is within the broadcast bound; beyond it an equi-join on
        (key, level, node) shuffles both sides, which AQE splits where a key is hot. An event is tried at
        the levels that the node table has, and no others.
        """
        segments = self._segments if segments is None else segments
        nodes = self.scratch.write(self._cut(segments).withColumnRenamed("_k", "_key"), f"nodes-{uuid.uuid4().hex}")
        levels = sorted(r[0] for r in nodes.select("_lvl").distinct().collect())  # as many as the span of time has binary digits
        ev = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("_n", self._enclosing(F.col(ts), levels or [0]))
        on = (ev[key] == nodes["_key"]) & (ev["_n._lvl"] == nodes["_lvl"]) & (ev["_n._node"] == nodes["_node"])
        exact = on & (nodes["_s"].isNull() | (nodes["_s"] <= ev[ts])) & (nodes["_e"].isNull() | (ev[ts] < nodes["_e"]))
        return ev.join(bounded_broadcast(nodes), exact).drop("_n", "_key", "_lvl", "_node")

    def enrich(self, events: DataFrame, key: str, ts: str, prefix: str = "") -> DataFrame:
        """Every event once, with version and attributes as known at its time, or nulls.

        An attribute whose name an event column already has is returned as `asof_<name>`.
        """
        taken = {c.lower() for c in events.columns}
        names = {a: (f"{prefix}{a}" if f"{prefix}{a}".lower() not in taken else f"asof_{a}") for a in [self.cols.version, *self.attributes]}
        hit = self.matched(events, key, ts)
        attr = [F.col(f"_attr.{a}").alias(names[a]) for a in self.attributes if a != self.cols.version]
        out = hit.select(*events.columns, F.col("_v").alias(names[self.cols.version]), *attr)
        known = self.scratch.write(self._segments.select(F.col("_k").alias("_key")).distinct(), f"known-{uuid.uuid4().hex}")
        lost = events.join(
            bounded_broadcast(known),
            (events[key] == F.col("_key")) & events[ts].isNotNull(), "left_anti",
        )
        kinds = dict(out.dtypes)
        return out.unionByName(lost.select(*events.columns, *[F.lit(None).cast(kinds[n]).alias(n) for n in dict.fromkeys(
            [names[self.cols.version], *[names[a] for a in self.attributes if a != self.cols.version]])]))
