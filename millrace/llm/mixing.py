"""Mixing sources to target weights: Pareto order sampling.

A document's expected copies grow with its size and stop at its source's cap; the whole part is
certain, the rest is an inclusion probability. Documents are ranked by the odds of a random number
divided by the odds of inclusion, and the first ones are taken until the source's tokens are met.
The random number is a digest of seed and id, so the sample is the same for any partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.tokens import sized
from millrace.session import Scratch, text_batches

#: Size cells per factor of e in which a source's sizes are counted to fix its sampling rate.
SIZE_CELLS = 32
#: Resolutions (cells per factor of e) at which the cut in the ranking is narrowed before rows are ordered.
RESOLUTIONS = (64, 1 << 13, 1 << 20)
#: Source names that may have a target; more are refused. Every frame that is broadcast here has one row per target, so this
#: bounds them all.
MOST_TARGETS = 10_000


def normal(source: str = "source"):
    """A source's name without outer blanks and case; null for blank."""
    return F.nullif(F.lower(F.trim(F.col(source))), F.lit(""))


def rate(cells: list[tuple[int, float, float]], cap: int, need: float) -> float:
    """c so that the sum of tokens * min(cap, c * tokens) is need; cells: (documents, mean tokens, mean of squares)."""
    most = sum(n * t * cap for n, t, _ in cells)
    if most <= 0 or need <= 0:
        return 0.0
    if need >= most * (1 - 1e-12):
        return math.inf
    low, high = 0.0, cap / min(t for _, t, _ in cells if t > 0) + 1
    for _ in range(100):
        mid = (low + high) / 2
        got = sum(n * (t * cap if mid * t >= cap else mid * q) for n, t, q in cells)
        low, high = (mid, high) if got < need else (low, mid)
    return high


class Mixer:
    """Draws documents so that each source's tokens meet its target share.

    The total is the largest that every source with a target and documents can serve without
    repeating a document more than max_repeats times. A source without a target is not drawn; a target
    without documents, or with empty documents only, gets an actual share of 0. Null sources have no
    target, null texts no tokens; documents without tokens are never drawn. Targets that repeat a
    name are added up (the smallest cap holds). Repeated documents are drawn by themselves.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, seed: int = 7, path: str | None = None):
        self.spark, self.seed = documents.sparkSession, seed
        self.scratch = Scratch(self.spark, "mixing")
        clean = targets.select(normal().alias("source"), "target_share", "max_repeats").filter("source IS NOT NULL AND target_share > 0 AND max_repeats >= 1")
        rows = clean.groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("cap")).limit(MOST_TARGETS + 1).collect()
        if len(rows) > MOST_TARGETS:
            raise ValueError("too many targets")
        self.targets = {r.source: (float(r.share), int(r.cap)) for r in rows}
        schema = "source string, share double, cap int"
        self.wanted = self.spark.createDataFrame([(s, *t) for s, t in self.targets.items()], schema)
        # documents of other sources never reach the tokenizer
        drawn = documents.withColumn("_s", normal()).join(F.broadcast(self.wanted.select(F.col("source").alias("_s"))), "_s", "left_semi")
        with text_batches(self.spark):
            self.sizes = self.scratch.write(sized(drawn, "_s", path=path).withColumnRenamed("_s", "source"), "sizes")

    def plan(self) -> DataFrame:
        """(source, rate, need): sampling rate and tokens wanted; from counts per size cell, which are bounded."""
        cell = F.floor(F.log("tokens") * SIZE_CELLS)
        got = self.sizes.filter("tokens > 0").groupBy("source", cell.alias("cell")).agg(
            F.count("*").alias("n"), F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("tokens").cast("double")).alias("q")).collect()
        cells: dict[str, list] = {}
        for r in got:
            cells.setdefault(r.source, []).append((r.n, r.t / r.n, r.q / r.n))
        have = {s: sum(n * t for n, t, _ in c) for s, c in cells.items()}
        shares = sum(self.targets[s][0] for s in have)
        total = min((have[s] * self.targets[s][1] * shares / self.targets[s][0] for s in have), default=0.0)
        self.total = total
        out = []
        for s in sorted(have):
            need = total * self.targets[s][0] / shares
            c = rate(cells[s], self.targets[s][1], need)
            out.append((s, min(c, 1e300), need, self.targets[s][1]))
        return self.spark.createDataFrame(out, "source string, rate double, need double, cap int")

    def sample(self) -> DataFrame:
        """(doc_id, source, tokens, copies) of every document that is drawn."""
        plan = self.plan()
        rows = self.sizes.filter("tokens > 0").join(F.broadcast(plan), "source")
        expected = F.least(F.col("cap").cast("double"), F.col("rate") * F.col("tokens"))
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), "doc_id", "tokens"), 11) + 0.5) / float(1 << 53)
        rows = rows.withColumn("sure", F.floor(expected + 1e-9).cast("int")).withColumn("pi", F.greatest(F.lit(0.0), expected - F.col("sure")))
        # the logarithm of (u / (1 - u)) / (pi / (1 - pi)) ranks like the quotient
        rank = F.log(u / (1 - u)) - F.log(F.col("pi") / (1 - F.col("pi")))
        rows = self.scratch.write(rows.select("doc_id", "source", "tokens", "need", "sure", F.when(F.col("pi") > 1e-9, rank).alias("rank")), "ranked")
        left = rows.groupBy("source", "need").agg(F.sum(F.col("tokens") * F.col("sure")).alias("t"))
        open_ = {r.source: (r.need - r.t, 0.0) for r in left.collect()}
        cuts = self._cut(rows.filter("rank IS NOT NULL"), {s: x[0] for s, x in open_.items()})
        chosen = rows.join(F.broadcast(cuts), "source", "left")
        at = F.struct("rank", "doc_id")
        extra = F.col("rank").isNotNull() & F.col("cut").isNotNull() & (at <= F.col("cut"))
        return chosen.withColumn("copies", F.col("sure") + F.when(extra, 1).otherwise(0)).filter("copies > 0").select("doc_id", "source", "tokens", "copies")

    def _cut(self, ranked: DataFrame, goal: dict[str, float]) -> DataFrame:
        """(source, cut): the last (rank, doc_id) of each source that is taken. Each resolution sums the tokens of the
        cells inside the cell that the cut fell in; rows are ordered only in the last, narrow cell."""
        goal = {s: g for s, g in goal.items() if g > 0}
        rest, pending = ranked, dict(goal)
        within: dict[str, tuple[int, float]] = {}
        for k, res in enumerate(RESOLUTIONS):
            cell = F.floor(F.col("rank") * res)
            if k:
                before = self.spark.createDataFrame([(s, c) for s, (c, _) in within.items()] or [], "source string, was bigint")
                rest = rest.join(F.broadcast(before), "source").filter(F.floor(F.col("rank") * RESOLUTIONS[k - 1]) == F.col("was")).drop("was")
            sums = rest.groupBy("source", cell.alias("cell")).agg(F.sum("tokens").alias("t"))
            w = Window.partitionBy("source").orderBy("cell")
            # one source has a bounded number of cells: the range of ranks times the resolution, or the quotient of two resolutions
            need = self.spark.createDataFrame(list(pending.items()), "source string, g double") if pending else None
            if need is None:
                return self.spark.createDataFrame([], "source string, cut struct<rank:double,doc_id:bigint>")
            hit = sums.withColumn("c", F.sum("t").over(w)).join(F.broadcast(need), "source").withColumn("last", F.max("cell").over(Window.partitionBy("source")))
            hit = hit.filter(((F.col("c") >= F.col("g")) & (F.col("c") - F.col("t") < F.col("g"))) | ((F.col("cell") == F.col("last")) & (F.col("c") < F.col("g"))))
            within = {r.source: (r.cell, r.g - (r.c - r.t)) for r in hit.collect()}
            pending = {s: g for s, (_, g) in within.items()}
        last = self.spark.createDataFrame([(s, c, g) for s, (c, g) in within.items()] or [], "source string, was bigint, g double")
        rest = rest.join(F.broadcast(last), "source").filter(F.floor(F.col("rank") * RESOLUTIONS[-1]) == F.col("was"))
        w = Window.partitionBy("source").orderBy("rank", "doc_id")
        taken = rest.withColumn("c", F.sum("tokens").over(w)).filter(F.col("c") - F.col("tokens") / 2 <= F.col("g"))
        none = F.struct(F.col("lowest").alias("rank"), F.lit(-(1 << 63)).alias("doc_id"))
        lowest = self.spark.createDataFrame([(s, c / RESOLUTIONS[-1]) for s, (c, _) in within.items()] or [], "source string, lowest double")
        cut = taken.groupBy("source").agg(F.max(F.struct("rank", "doc_id")).alias("cut"))
        return F.broadcast(lowest).join(cut, "source", "left").select("source", F.coalesce("cut", none).alias("cut"))

    def shares(self, sample: DataFrame) -> DataFrame:
        """(source, target_share, actual_share, tokens, documents, most_copies) of every target, drawn or not."""
        got = sample.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
        every = self.wanted.join(F.broadcast(got), "source", "left").fillna(0, ["tokens", "documents", "most_copies"])
        total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row per target
        return every.select("source", F.col("share").alias("target_share"), F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)).alias("actual_share"), "tokens", "documents", "most_copies")
