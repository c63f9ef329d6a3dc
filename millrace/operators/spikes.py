"""Implausible spikes in measurements, judged per source.

Every possible positive reading is counted in a logarithmic cell (relative width CELL). The counts per
(source, hour context, reading, cell) are a quantile sketch that merges by addition, so Spark's
partial aggregation builds and merges it across partitions, and a source that holds a third of all
rows is no more rows here than any other. Fences stand a number of interquartile ranges outside the
quartiles; that expansion is fitted per reading and side where the readings of all sources are sparsest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import Scratch, bounded_broadcast

#: Relative width of a sketch cell: a quantile is off by at most half of it.
CELL = 0.02
#: A context's level counts in full beyond about so many rides; below, the source's own level leads.
CONTEXT_WEIGHT = 50
#: A source's quartile distances count in full beyond about so many rides; below, those of all sources lead.
SPREAD_WEIGHT = 150
#: Sources with fewer readings have no normal behaviour to judge by.
LEAST_READINGS = 8
#: Fences stand about this many interquartile ranges outside the quartiles (the usual outer fence), ...
EXPANSION = 3.0
#: ... at the sparsest place between these; a window of this half width is counted at each step of this size.
EXPANSIONS, HALF_WINDOW, STEP = (2.0, 5.0), 0.25, 0.1
#: A reading this many times above or below both its neighbours in time is a jump, if it also lies outside the
#: inner fences, which stand INNER interquartile ranges outside the quartiles.
JUMP, INNER = 25.0, 1.5
#: So many rides in a row with exactly the same reading are a stuck sensor.
STUCK_RUN = 6
#: Sources with more rows than this are cut, in order of time and id, into parts of about so many rows; the cuts are stitched.
SPLIT_ROWS = 200_000
#: Stands for the number of rows among the readings of a sketch.
ROWS = -1


@dataclass(frozen=True)
class Reading:
    """A measured column, and what is possible at all."""

    name: str
    lowest: float
    highest: float
    zero_possible: bool = True


def sparsest(counts: dict[int, int]) -> float:
    """The expansion between EXPANSIONS around which the fewest readings lie; EXPANSION where none do, and the one
    nearest to it among equals. counts: readings per distance in steps."""
    best = (math.inf, EXPANSION)
    half = round(HALF_WINDOW / STEP)
    for k in range(round(EXPANSIONS[0] / STEP), round(EXPANSIONS[1] / STEP) + 1):
        n = sum(counts.get(i, 0) for i in range(k - half, k + half + 1))
        best = min(best, (n + 0.5 * abs(k * STEP - EXPANSION), k * STEP))
    return best[1]


@dataclass
class SpikeDetector:
    """Flags readings per source.

    Nulls are never flagged and break a run of equal readings; NaN counts as impossible. A null
    source has no normal behaviour and no runs: only impossible readings are flagged. Ties in time
    are ordered by row id; rows without a time come first. A jump needs a positive reading in the row
    before and the row after. Sources with fewer than LEAST_READINGS readings are checked for impossible
    and stuck readings only. An empty table gives no rows. The number of rows beyond which a source is
    cut (`split_rows`) does not change any result.
    """

    source: str
    ts: str
    row_id: str
    readings: list[Reading]
    split_rows: int = SPLIT_ROWS
    contexts: int = 4
    scratch: Scratch | None = field(default=None)

    def _context(self) -> Column:
        return F.floor(F.coalesce(F.hour("_t"), F.lit(0)) * self.contexts / 24).cast("int")

    def _base(self, df: DataFrame) -> DataFrame:
        return df.select(F.col(self.row_id).alias("_id"), F.col(self.source).alias("_src"), F.col(self.ts).alias("_t"),
                         *[F.col(r.name).cast("double").alias(f"_r{i}") for i, r in enumerate(self.readings)])

    def sketch(self, df: DataFrame) -> DataFrame:
        """(_src, _ctx, _m, _cell, n): mergeable; the sum of two tables' sketches is the sketch of their union. Rows are
        counted too, as reading ROWS."""
        width = math.log1p(CELL)
        cell = lambda i, r: F.when((F.col(f"_r{i}") > 0) & (F.col(f"_r{i}") >= r.lowest) & (F.col(f"_r{i}") <= r.highest), F.floor(F.log(F.col(f"_r{i}")) / width).cast("int"))
        each = F.explode(F.array(F.struct(F.lit(ROWS).alias("m"), F.lit(0).alias("cell")),
                                 *[F.struct(F.lit(i).alias("m"), cell(i, r).alias("cell")) for i, r in enumerate(self.readings)]))
        return self._base(df).filter("_src IS NOT NULL").select("_src", self._context().alias("_ctx"), each.alias("_x")).select(
            "_src", "_ctx", F.col("_x.m").alias("_m"), F.col("_x.cell").alias("_cell")).filter("_cell IS NOT NULL").groupBy(
            "_src", "_ctx", "_m", "_cell").agg(F.count("*").alias("n"))

    @staticmethod
    def _quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
        """Quartiles (logarithms) of a sketch: one running sum over the cells of a group, which are few."""
        w = Window.partitionBy(*by).orderBy("_cell")
        cum = sketch.groupBy(*by, "_cell").agg(F.sum("n").alias("n")).withColumn("c", F.sum("n").over(w)).withColumn("t", F.sum("n").over(Window.partitionBy(*by)))
        width = math.log1p(CELL)
        q = [F.min(F.when(F.col("c") >= F.col("t") * p, F.col("_cell"))).alias(a) for p, a in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))]
        return cum.groupBy(*by).agg(*q, F.max("t").alias("n")).select(*by, "n", *[((F.col(a) + 0.5) * width).alias(a) for a in ("q1", "q2", "q3")])

    def levels(self, sketch: DataFrame) -> DataFrame:
        """(_src, _ctx, _m, level, down, up): the usual logarithm of a reading, and the distances of its quartiles. A context's
        level leans on its source's, a source's spread on that of all sources, the more the fewer readings it has."""
        sketch = sketch.filter(F.col("_m") != ROWS)
        whole = self._quartiles(sketch, ["_src", "_m"]).filter(F.col("n") >= LEAST_READINGS)
        pooled = F.broadcast(whole.groupBy("_m").agg(  # one row per reading
            (F.sum(F.col("n") * (F.col("q2") - F.col("q1"))) / F.sum("n")).alias("pd"), (F.sum(F.col("n") * (F.col("q3") - F.col("q2"))) / F.sum("n")).alias("pu")))
        part = self._quartiles(sketch, ["_src", "_ctx", "_m"]).select("_src", "_ctx", "_m", F.col("n").alias("cn"), F.col("q2").alias("c2"))
        # every context of a source has fences, also one in which it was never read
        every = whole.join(pooled, "_m").withColumn("_ctx", F.explode(F.array(*[F.lit(i) for i in range(self.contexts)])))
        f = every.join(part, ["_src", "_ctx", "_m"], "left")
        cn, c2 = F.coalesce(F.col("cn"), F.lit(0)), F.coalesce(F.col("c2"), F.col("q2"))
        spread = lambda own, pool: (own * F.col("n") + F.col(pool) * SPREAD_WEIGHT) / (F.col("n") + SPREAD_WEIGHT)
        return f.select("_src", "_ctx", "_m", ((c2 * cn + F.col("q2") * CONTEXT_WEIGHT) / (cn + CONTEXT_WEIGHT)).alias("level"),
                        spread(F.col("q2") - F.col("q1"), "pd").alias("down"), spread(F.col("q3") - F.col("q2"), "pu").alias("up"))

    def expansions(self, sketch: DataFrame, levels: DataFrame) -> dict[tuple[int, bool], float]:
        """Interquartile ranges from quartile to fence per (reading, above): the sparsest place of all readings together."""
        x = (F.col("_cell") + 0.5) * math.log1p(CELL) - F.col("level")
        above = x > 0
        away = F.round((F.when(above, x - F.col("up")).otherwise(-x - F.col("down"))) / F.greatest(F.col("up") + F.col("down"), F.lit(CELL)) / STEP)
        near = (EXPANSIONS[0] - 2 * HALF_WINDOW) / STEP, (EXPANSIONS[1] + 2 * HALF_WINDOW) / STEP
        got = sketch.join(levels, ["_src", "_ctx", "_m"]).select("_m", above.alias("above"), away.cast("int").alias("away"), "n").filter(
            F.col("away").between(*near)).groupBy("_m", "above", "away").agg(F.sum("n").alias("n")).collect()  # at most 40 rows a reading and side
        return {(m, a): sparsest({r.away: r.n for r in got if (r._m, r.above) == (m, a)}) for m in range(len(self.readings)) for a in (False, True)}

    def fences(self, levels: DataFrame, expansions: dict[tuple[int, bool], float]) -> DataFrame:
        """(_src, _ctx, _fences: map of reading number to outer (lo, hi) and inner (ilo, ihi) fences), in the reading's own unit."""
        k = {a: F.create_map(*[x for (m, s), e in expansions.items() if s == a for x in (F.lit(m), F.lit(e))])[F.col("_m")] for a in (False, True)}
        iqr = F.greatest(F.col("up") + F.col("down"), F.lit(CELL))
        lo, hi = F.col("level") - F.col("down"), F.col("level") + F.col("up")
        one = F.struct(F.exp(lo - iqr * k[False]).alias("lo"), F.exp(hi + iqr * k[True]).alias("hi"), F.exp(lo - iqr * INNER).alias("ilo"), F.exp(hi + iqr * INNER).alias("ihi"))
        return levels.groupBy("_src", "_ctx").agg(F.map_from_entries(F.collect_list(F.struct(F.col("_m"), one.alias("f")))).alias("_fences"))  # an entry a reading

    def _cut(self, base: DataFrame, sketch: DataFrame, scratch: Scratch) -> DataFrame:
        """base with the number of its cut, 0 unless its source is hot; at the first and last row of a cut stand the readings
        before and after it. Cuts are range partitions by source, time and id, so even rows without a time, or of one
        and the same time, are cut."""
        hot = scratch.write(sketch.filter(F.col("_m") == ROWS).groupBy("_src").agg(F.sum("n").alias("_n")).filter(F.col("_n") > self.split_rows), "hot")
        total = hot.agg(F.sum("_n")).first()[0] or 0
        self._hot = total > 0
        r = [f"_r{i}" for i in range(len(self.readings))]
        none = F.lit(None).cast("struct<" + ",".join(f"{x}:double" for x in r) + ">")
        if not self._hot:
            return base.withColumns({"_cut": F.lit(0), "_prev": none, "_next": none})
        named = F.broadcast(hot.select("_src"))  # at most one source per split_rows rows
        parts = base.join(named, "_src", "left_semi").repartitionByRange(-(-total // self.split_rows), "_src", F.asc_nulls_first("_t"), "_id")
        parts = scratch.write(parts.withColumn("_cut", F.spark_partition_id()), "parts")
        at = F.struct("_t", "_id", *r)
        ends = parts.groupBy("_src", "_cut").agg(F.min(at).alias("first"), F.max(at).alias("last"))
        w = Window.partitionBy("_src").orderBy("_cut")  # a row per cut
        ends = scratch.write(ends.select("_src", "_cut", F.row_number().over(w).alias("_ord"), F.lag(F.struct(*[F.col(f"last.{x}") for x in r])).over(w).alias("_prev"),
                                         F.lead(F.struct(*[F.col(f"first.{x}") for x in r])).over(w).alias("_next")), "ends")
        self._cuts = ends.select("_src", "_cut", "_ord")
        cold = base.join(named, "_src", "left_anti").withColumns({"_cut": F.lit(0), "_prev": none, "_next": none})
        return cold.unionByName(parts.join(F.broadcast(ends.drop("_ord")), ["_src", "_cut"]))

    def _ordered(self, df: DataFrame, sketch: DataFrame, fences: DataFrame, scratch: Scratch) -> DataFrame:
        """Readings that are outside a fence, impossible, a jump, or may be part of a run: (_id, _src, _cut, m, v, g, f, l, run, jump,
        why), written. All window functions share one shuffle and one sort by time."""
        rows = self._cut(self._base(df).filter("_src IS NOT NULL"), sketch, scratch)
        w = Window.partitionBy("_src", "_cut").orderBy(F.asc_nulls_first("_t"), "_id")
        k = range(len(self.readings))
        rows = rows.withColumns({f"_p{i}": F.lag(f"_r{i}").over(w) for i in k} | {f"_q{i}": F.lead(f"_r{i}").over(w) for i in k} | {"_at": F.row_number().over(w), "_end": F.lead(F.lit(False), 1, True).over(w)})
        rows = rows.withColumns({f"_n{i}": F.when((F.col("_at") > 1) & (F.col(f"_p{i}") == F.col(f"_r{i}")), 0).otherwise(1) for i in k})
        rows = rows.withColumns({f"_g{i}": F.sum(f"_n{i}").over(w) for i in k} | {f"_m{i}": F.lead(f"_n{i}", 1, 1).over(w) for i in k})
        rows = rows.withColumns({f"_c{i}": F.max(f"_g{i}").over(Window.partitionBy("_src", "_cut")) if self._hot else F.lit(-1) for i in k})
        f = bounded_broadcast(fences.select(F.col("_src").alias("_fs"), F.col("_ctx").alias("_fc"), "_fences"))
        rows = rows.withColumn("_ctx", self._context()).join(f, (F.col("_src") == F.col("_fs")) & (F.col("_ctx") == F.col("_fc")), "left")
        log = lambda c: F.log(F.when((c > 0) & ~F.isnan(c), c))

        def entry(i: int) -> Column:
            v, lim = F.col(f"_r{i}"), F.col("_fences")[i]
            first, last = F.col(f"_g{i}") == 1, F.col(f"_g{i}") == F.col(f"_c{i}")
            run = (F.col(f"_n{i}") == 0) | (F.col(f"_m{i}") == 0) | ((F.col(f"_c{i}") >= 0) & (first | last))
            before = F.when(F.col("_at") == 1, F.col(f"_prev._r{i}")).otherwise(F.col(f"_p{i}"))
            after = F.when(F.col("_end"), F.col(f"_next._r{i}")).otherwise(F.col(f"_q{i}"))
            steps = [F.abs(log(v) - log(x)) > math.log(JUMP) for x in (before, after)]
            jump = F.coalesce(steps[0] & steps[1] & ((v > lim.ihi) | (v < lim.ilo)), F.lit(False))
            why = self._impossible(i)
            why = F.coalesce(why, F.when(v > lim.hi, "above fence").when(v < lim.lo, "below fence"))
            return F.when(v.isNotNull() & (run | jump | why.isNotNull()), F.struct(
                F.lit(i).alias("m"), v.alias("v"), F.col(f"_g{i}").alias("g"), first.alias("f"), last.alias("l"), run.alias("run"), jump.alias("jump"), why.alias("why")))

        each = F.explode(F.array(*[entry(i) for i in k]))
        return scratch.write(rows.select("_id", "_src", "_cut", each.alias("_x")).filter("_x IS NOT NULL").select("_id", "_src", "_cut", "_x.*"), "ordered")

    def _impossible(self, i: int) -> Column:
        v, r = F.col(f"_r{i}"), self.readings[i]
        bad = F.isnan(v) | (v < r.lowest) | (v > r.highest)
        return F.when(v.isNotNull() & (bad if r.zero_possible else bad | (v == 0)), "impossible")

    def runs(self, ordered: DataFrame) -> DataFrame:
        """(_id, m) of rows in a run of STUCK_RUN or more equal readings. The first and last run of every cut, a few
        rows each, are stitched across neighbouring cuts."""
        cand = ordered.filter("run")
        runs = cand.groupBy("_src", "m", "_cut", "g").agg(F.count("*").alias("n"), F.first("v").alias("v"), F.first("f").alias("f"), F.first("l").alias("l"))
        cols = ["_src", "m", "_cut", "g", "n"]
        if not self._hot:
            stuck = runs.select(*cols)
        else:
            border = runs.filter(F.col("f") | F.col("l")).join(self._cuts, ["_src", "_cut"])
            o = Window.partitionBy("_src", "m").orderBy("_cut", "g")
            same = F.col("f") & F.lag("l").over(o) & (F.lag("v").over(o) == F.col("v")) & (F.lag("_ord").over(o) == F.col("_ord") - 1)
            border = border.withColumn("_s", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_s").over(o))
            border = border.withColumn("n", F.sum("n").over(Window.partitionBy("_src", "m", "_run")))
            stuck = runs.join(border.select("_src", "m", "_cut", "g"), ["_src", "m", "_cut", "g"], "left_anti").select(*cols).unionByName(border.select(*cols))
        return cand.join(stuck.filter(F.col("n") >= STUCK_RUN).drop("n"), ["_src", "m", "_cut", "g"], "left_semi").select("_id", "m").distinct()

    def flags(self, df: DataFrame) -> DataFrame:
        """(row id, reading, reason) of every flagged reading; a reading may have several reasons: impossible, above fence,
        below fence, stuck, jump."""
        scratch = self.scratch = self.scratch or Scratch(df.sparkSession, "spikes")
        sketch = scratch.write(self.sketch(df), "sketch")
        levels = scratch.write(self.levels(sketch), "levels")
        fences = scratch.write(self.fences(levels, self.expansions(sketch, levels)), "fences")
        ordered = self._ordered(df, sketch, fences, scratch)
        out = ordered.select("_id", "m", F.explode(F.array_compact(F.array("why", F.when(F.col("jump"), "jump")))).alias("why"))
        out = out.unionByName(self.runs(ordered).select("_id", "m", F.lit("stuck").alias("why")))
        lost = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), self._impossible(i).alias("why")) for i in range(len(self.readings))]))
        out = out.unionByName(self._base(df).filter("_src IS NULL").select("_id", lost.alias("_x")).select("_id", "_x.*").filter("why IS NOT NULL"))
        names = F.array(*[F.lit(r.name) for r in self.readings])
        return out.select(F.col("_id").alias(self.row_id), names[F.col("m")].alias("reading"), F.col("why").alias("reason")).distinct()
