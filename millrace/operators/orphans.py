"""References to records that do not exist.

A key's life falls into spans between the instants at which one of its versions begins or ends; in a span it is
valid, or not yet, or no longer. References are aggregated per (field, key, month, span) before
anything is compared, so a key that holds a third of all rows is a few rows here. Groups of heavy
keys are checked by a broadcast, the rest by a shuffled anti-join; the orphan groups of both
together give the counts, and the rows, which are looked up by group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.times import yyyymm
from millrace.operators.asof import AsOf, Versions
from millrace.session import Scratch, bounded_broadcast

#: A key is heavy if it holds at least this share of all references; there are at most 1 / share heavy keys.
HEAVY_SHARE = 0.001
KEY = ["ref_field", "ref_id"]


@dataclass(frozen=True)
class Reference:
    """A referring column, and the table, id and life span it refers to."""

    field: str
    target: DataFrame
    id_col: str
    start: str
    end: str


def unpivot_refs(facts: DataFrame, row_id: str, ts: str, fields: list[str], once: bool = False) -> DataFrame:
    """(row_id, ts, ref_field, ref_id, month) of every non-null reference; one pass over the facts. once: repeated rows count once."""
    rows = facts.select(F.col(row_id).alias("row_id"), F.col(ts).alias("ts"), *[F.col(f).cast("bigint").alias(f"_f{i}") for i, f in enumerate(fields)])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("ref_field"), F.col(f"_f{i}").alias("ref_id")) for i, f in enumerate(fields)]))
    return (rows.distinct() if once else rows).select("row_id", "ts", yyyymm("ts").alias("month"), each.alias("_r")).select(
        "row_id", "ts", "month", "_r.ref_field", "_r.ref_id").filter("ref_id IS NOT NULL")


class OrphanFinder:
    """Finds orphan references of a fact table.

    Kinds: `missing` (the id is in no row of its table), `later` (before the id's first start),
    `deleted` (not before it, but no version valid). Null references are no orphans; a reference
    without a time can only be missing; rows whose start is null make an id known but never valid;
    an empty target table makes every reference missing. Repeated fact rows are reported once.
    """

    def __init__(self, facts: DataFrame, row_id: str, ts: str, references: list[Reference]):
        self.scratch = Scratch(facts.sparkSession, "orphans")
        self.refs = lambda once=False: unpivot_refs(facts, row_id, ts, [r.field for r in references], once)
        target = None
        for r in references:
            part = r.target.select(
                F.lit(r.field).alias("ref_field"), F.col(r.id_col).cast("bigint").alias("ref_id"),
                F.col(r.start).alias("start"), F.col(r.end).alias("end")).filter("ref_id IS NOT NULL")
            target = part if target is None else target.unionByName(part)
        self.spans = self.scratch.write(self._spans(target), "spans")

    def _spans(self, target: DataFrame) -> DataFrame:
        """(ref_field, ref_id, span, begins, kind): the spans of each known id's life, numbered from 0; kind is null where it is valid."""
        keyed = target.withColumn("_key", F.struct(*KEY)).withColumn("_one", F.lit(1))
        life = AsOf(keyed, Versions("_key", "start", "end", "_one"), ["_one"], self.scratch).segments().select("_k.*", F.col("_s").alias("begins"), "_valid")
        first = target.groupBy(*KEY).agg(F.min("start").alias("begins"))
        # every id has a span before all its instants; the first start begins a span even if that version was never valid
        points = life.unionByName(first.filter("begins IS NOT NULL").withColumn("_valid", F.lit(False))).unionByName(
            first.select(*KEY, F.lit(None).cast("timestamp_ntz").alias("begins"), F.lit(False).alias("_valid")))
        points = points.groupBy(*KEY, "begins").agg(F.max("_valid").alias("_valid")).join(first.withColumnRenamed("begins", "_first"), KEY)
        kind = F.when(~F.col("_valid"), F.when(F.col("begins").isNull() & F.col("_first").isNotNull(), "later").otherwise("deleted"))
        number = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.asc_nulls_first("begins"))) - 1  # as many as an id has versions, twice at most
        return points.select(*KEY, number.alias("span"), "begins", kind.alias("kind"))

    def _placed(self, refs: DataFrame) -> DataFrame:
        """refs with the number of the span they lie in; null for an unknown id or a reference without a time."""
        starts = self.spans.filter("begins IS NOT NULL").groupBy(*KEY).agg(F.collect_list("begins").alias("_b"))
        own = self.scratch.write(self.spans.select(*KEY).distinct().join(starts, KEY, "left"), "starts")
        number = F.when(F.col("ts").isNotNull(), F.size(F.filter(F.coalesce("_b", F.array().cast("array<timestamp_ntz>")), lambda b: b <= F.col("ts"))))
        known = own.withColumn("_known", F.lit(True))
        return refs.join(bounded_broadcast(known), KEY, "left").withColumn("span", F.when(F.col("_known"), number)).drop("_b", "_known")

    def orphans(self, once: bool = False) -> DataFrame:
        """(ref_field, ref_id, month, span, orphan_kind, n): the groups of references that are orphans, written."""
        groups = self.scratch.write(self._placed(self.refs(once)).groupBy(*KEY, "month", "span").agg(F.count("*").alias("n")), f"groups-{once}")
        total = groups.agg(F.sum("n")).first()[0] or 0
        hot = F.broadcast(self.scratch.write(groups.groupBy(*KEY).agg(F.sum("n").alias("_n")).filter(F.col("_n") >= total * HEAVY_SHARE).select(*KEY), f"hot-{once}"))  # at most 1 / HEAVY_SHARE
        heavy, light = groups.join(hot, KEY, "left_semi"), groups.join(hot, KEY, "left_anti")

        def checked(part: DataFrame, spans: DataFrame, how) -> DataFrame:
            known, bad = how(spans.select(*KEY).distinct()), how(spans.filter("kind IS NOT NULL").select(*KEY, "span", F.col("kind").alias("orphan_kind")))
            missing = part.join(known, KEY, "left_anti").withColumn("orphan_kind", F.lit("missing"))
            return missing.unionByName(part.join(bad, [*KEY, "span"]).select(*missing.columns))

        # of the tables referred to, heavy keys need their own spans only
        few = self.scratch.write(self.spans.join(hot, KEY, "left_semi"), f"heavy-{once}")
        found = checked(heavy, few, bounded_broadcast).unionByName(checked(light, self.spans, lambda df: df.hint("shuffle_hash")))
        return self.scratch.write(found, f"orphans-{once}")

    def found(self) -> DataFrame:
        """(row_id, ref_field, orphan_kind, month), each once: the rows of the orphan groups."""
        bad = self.orphans().select(*KEY, "span", "orphan_kind").distinct()
        bad = bad.select(*[F.col(c).alias(f"_{c}") for c in (*KEY, "span")], "orphan_kind")
        rows = self._placed(self.refs())
        on = (F.col("ref_field") == F.col("_ref_field")) & (F.col("ref_id") == F.col("_ref_id")) & F.col("span").eqNullSafe(F.col("_span"))
        return rows.join(bounded_broadcast(bad), on).select("row_id", "ref_field", "orphan_kind", "month").distinct()

    def counts(self) -> DataFrame:
        """(ref_field, month, orphan_kind, orphans): the groups' counts added up; no row is read for it again."""
        return self.orphans(once=True).groupBy("ref_field", "month", "orphan_kind").agg(F.sum("n").alias("orphans"))
