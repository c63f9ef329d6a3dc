"""Percentiles of very large numeric columns by exact bisection.

A mergeable state counts values per (group, column, cell), a cell being 1 / per_unit wide: states of
separate days or partitions merge by adding counts. Percentiles come from the state by bisection:
every (group, column, percentile) keeps an interval of cells that holds its target rank; each pass
counts the rows below the midpoints of all intervals at once and narrows them. With `split` - 1
midpoints a pass, an interval of w cells is resolved in log(w) / log(split) passes.

Error bound: half a cell, 0.5 / per_unit, absolute; none if values are multiples of 1 / per_unit. Beyond
EXACT cells from zero, where doubles are wider apart than cells, cells grow with the value (relative
width 2^-40) and the bound is relative; infinite values have the outermost cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import Scratch, bounded_broadcast

#: Cells up to this number are equally wide; it is where doubles stop holding every whole number.
EXACT = 1 << 53
#: Cells per doubling beyond it, and the cell of infinite values.
PER_DOUBLING, OUTERMOST = 1 << 40, 1 << 61


@dataclass
class Percentiles:
    """Percentile p of n values is the one of rank max(1, ceil(p * n)).

    Null and NaN are no values; infinite and very large ones count like any other, in their place. A null
    group is a group of its own; repeated rows count as often as they occur; groups without any value
    give no rows.
    """

    by: list[str]
    columns: list[str]
    probabilities: list[float]
    per_unit: int = 100
    split: int = 64

    def _cell(self, v: Column) -> Column:
        """The cell of a value; cells grow with values."""
        x = F.abs(v * self.per_unit)
        far = EXACT + F.round((F.log2(F.abs(v)) + math.log2(self.per_unit) - 53) * PER_DOUBLING).cast("bigint")
        size = F.when(F.abs(v) == math.inf, F.lit(OUTERMOST)).when(x < EXACT, F.round(x).cast("bigint")).otherwise(F.greatest(F.lit(EXACT), far))
        return F.when(v < 0, -size).otherwise(size)

    def _value(self, cell: Column) -> tuple[Column, Column]:
        """A cell's value and error bound."""
        n = F.abs(cell)
        far = F.pow(F.lit(2.0), (n - EXACT) / float(PER_DOUBLING) + (53 - math.log2(self.per_unit)))
        size = F.when(n < EXACT, n / F.lit(float(self.per_unit))).when(n == OUTERMOST, F.lit(math.inf)).otherwise(far)
        bound = F.when((n < EXACT) | (n == OUTERMOST), F.lit(0.5 / self.per_unit)).otherwise(far / float(PER_DOUBLING))
        return F.when(cell < 0, -size).otherwise(size), bound

    def state(self, df: DataFrame, *also: str) -> DataFrame:
        """(by..., also..., column, cell, n); map-side combined, so a hot group sends its distinct cells only."""
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in self.columns]))
        keys = [*self.by, *also]
        rows = df.select(*keys, each.alias("_x")).select(*keys, "_x.column", "_x.v").filter(F.col("v").isNotNull() & ~F.isnan("v"))
        return rows.groupBy(*keys, "column", self._cell(F.col("v")).alias("cell")).agg(F.count("*").alias("n"))

    def merge(self, *states: DataFrame) -> DataFrame:
        """The state of all rows of several states."""
        out = states[0]
        for s in states[1:]:
            out = out.unionByName(s)
        return out.groupBy(*self.by, "column", "cell").agg(F.sum("n").alias("n"))

    def resolve(self, state: DataFrame) -> DataFrame:
        """(by..., column, probability, value, n, error_bound): the value is off by at most the bound."""
        scratch = Scratch(state.sparkSession, "percentiles")
        keys = [*self.by, "column"]
        cells = scratch.write(state.select(*keys, "cell", "n"), "cells")
        p = F.explode(F.array(*[F.lit(float(x)) for x in self.probabilities]))
        goal = cells.groupBy(*keys).agg(F.sum("n").alias("total"), F.min("cell").alias("lo"), F.max("cell").alias("hi")).withColumn("probability", p).withColumn(
            "rank", F.greatest(F.lit(1), F.ceil(F.col("probability") * F.col("total")))).withColumn("below", F.lit(0).cast("bigint"))
        goal = scratch.write(goal, "pass0")
        n = 0
        while not goal.filter("lo < hi").isEmpty():
            step = F.expr(f"(hi - lo) div {self.split} + 1")
            g = goal.select(*[F.col(k).alias(f"_{k}") for k in keys], "probability", "total", "rank", "below", "lo", "hi", step.alias("step"))
            on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("cell").between(F.col("lo"), F.col("hi"))]
            cond = on[0]
            for c in on[1:]:
                cond = cond & c
            met = cells.join(bounded_broadcast(g), cond)
            own = [*[f"_{k}" for k in keys], "probability", "total", "rank", "below", "lo", "hi", "step"]
            part = met.groupBy(*own, F.expr("(cell - lo) div step").alias("part")).agg(F.sum("n").alias("n"))
            w = Window.partitionBy(*own).orderBy("part")  # at most `split` rows a group
            part = part.withColumn("upto", F.col("below") + F.sum("n").over(w))
            hit = part.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
            start = F.col("lo") + F.col("part") * F.col("step")
            narrowed = hit.select(*[F.col(f"_{k}").alias(k) for k in keys], "total", start.alias("lo"), F.least(F.col("hi"), start + F.col("step") - 1).alias("hi"),
                                  "probability", "rank", (F.col("upto") - F.col("n")).alias("below"))
            n += 1
            goal = scratch.write(narrowed, f"pass{n}")
        value, bound = self._value(F.col("lo"))
        return goal.select(*keys, "probability", value.alias("value"), F.col("total").alias("n"), bound.alias("error_bound"))
