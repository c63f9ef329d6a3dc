"""Data-quality rules: seven types, evaluated with one aggregation per table for all that fit into one."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_SCHEMA = ("run_id string, env string, layer string, rule_name string, table_name string, rule_type string, severity string, "
                 "total_rows bigint, failed_rows bigint, passed boolean, checked_at timestamp_ntz")

#: Parameters that each rule type needs.
NEEDS = {"not_null": ("column",), "unique": ("column",), "accepted_values": ("column", "values"), "range": ("column",),
         "row_count_min": ("threshold",), "freshness": ("column", "max_age_days"), "referential": ("column", "ref_table", "ref_column")}


class DQError(RuntimeError):
    """Rules of severity error failed; their results are stored."""


@dataclass(frozen=True)
class DQRule:
    """A rule. column may be a list for unique; min and max are inclusive and may be absent."""

    name: str
    table: str
    type: str
    layer: str = ""
    severity: str = "error"
    column: str | tuple[str, ...] | None = None
    values: tuple | None = None
    min: float | None = None
    max: float | None = None
    threshold: int | None = None
    max_age_days: int | None = None
    ref_table: str | None = None
    ref_column: str | None = None

    @staticmethod
    def of(d: dict) -> "DQRule":
        if d.get("type") not in NEEDS:
            raise ValueError(f"unknown rule type {d.get('type')!r} in rule {d.get('name')!r}")
        lacking = [k for k in NEEDS[d["type"]] if d.get(k) is None]
        if lacking:
            raise ValueError(f"rule {d.get('name')!r} lacks {', '.join(lacking)}")
        return DQRule(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()})


def load_rules(path: str, layer: str | None = None) -> list[DQRule]:
    """Rules of a YAML or JSON file, of one layer or all. Unknown types are refused here."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            found = json.load(f)["rules"]
        else:
            import yaml

            found = yaml.safe_load(f)["rules"]
    return [r for r in map(DQRule.of, found) if not layer or r.layer == layer]


def _fused(rule: DQRule, now: Column) -> Column | None:
    """The rule's failed rows as an aggregate of its table, or None if it needs a job of its own."""
    c = F.col(rule.column) if isinstance(rule.column, str) else None
    if rule.type == "not_null":
        return F.count_if(c.isNull())
    if rule.type == "accepted_values":
        return F.count_if(c.isNotNull() & ~c.isin(*rule.values))
    if rule.type == "range":
        bad = F.lit(False)
        if rule.min is not None:
            bad = bad | (c < rule.min)
        if rule.max is not None:
            bad = bad | (c > rule.max)
        return F.count_if(bad)
    if rule.type == "row_count_min":
        return F.when(F.count("*") < rule.threshold, 1).otherwise(0)
    if rule.type == "freshness":
        age = F.unix_timestamp(now) - F.unix_timestamp(F.max(c).cast("timestamp"))
        return F.when(age.isNull() | (F.floor(age / 86400) > rule.max_age_days), 1).otherwise(0)
    return None


def duplicated_groups(df: DataFrame, columns: list[str]) -> DataFrame:
    """Key groups with more than one row; null keys equal null keys."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def orphan_rows(df: DataFrame, column: str, ref: DataFrame, ref_column: str) -> DataFrame:
    """(key, n) of keys that are not in ref: rows are counted per key before the join. Null keys are no orphans;
    ref values that cannot be read as the key's type match nothing."""
    kind = dict(df.dtypes)[column]
    have = ref.select(F.col(ref_column).try_cast(kind).alias("_ref")).filter("_ref IS NOT NULL").distinct()
    keys = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"))
    return keys.join(have, F.col("key") == F.col("_ref"), "left_anti")


class Evaluator:
    """Evaluates rules over tables that `table(name)` gives. A rule that raises counts as failed, with failed_rows -1.

    not_null, accepted_values, range, row_count_min and freshness of one table share one pass;
    unique and referential run one aggregation each.
    """

    def __init__(self, spark: SparkSession, table: Callable[[str], DataFrame], now: str):
        self.spark, self.table = spark, table
        self.now = F.lit(now).cast("timestamp")
        self.stamp = now

    def evaluate(self, rules: list[DQRule]) -> list[tuple[DQRule, int, int]]:
        """(rule, total rows, failed rows), in the order of the rules."""
        got: dict[int, tuple[int, int]] = {}
        by_table: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            by_table.setdefault(r.table, []).append(i)
        for name, own in by_table.items():
            try:
                df = self.table(name)
            except Exception:
                got |= {i: (0, -1) for i in own}
                continue
            got |= self._one_table(df, rules, own)
        return [(r, *got[i]) for i, r in enumerate(rules)]

    def _one_table(self, df: DataFrame, rules: list[DQRule], own: list[int]) -> dict[int, tuple[int, int]]:
        """The fused pass; if a rule of it cannot be planned, each is tried alone."""
        out: dict[int, tuple[int, int]] = {}
        parts = {i: a for i in own if (a := _fused(rules[i], self.now)) is not None}
        try:
            row = df.agg(F.count("*").alias("total"), *[a.cast("bigint").alias(f"r{i}") for i, a in parts.items()]).first()
            total = row.total
            out |= {i: (total, row[f"r{i}"]) for i in parts}
        except Exception:
            total = df.count()
            for i, a in parts.items():
                try:
                    out[i] = (total, df.agg(a.cast("bigint").alias("n")).first().n)
                except Exception:
                    out[i] = (total, -1)
        for i in own:
            if i not in parts:
                try:
                    out[i] = (total, self._alone(df, rules[i]))
                except Exception:
                    out[i] = (total, -1)
        return out

    def _alone(self, df: DataFrame, rule: DQRule) -> int:
        if rule.type == "unique":
            cols = [rule.column] if isinstance(rule.column, str) else list(rule.column)
            return duplicated_groups(df, cols).count()
        n = orphan_rows(df, rule.column, self.table(rule.ref_table), rule.ref_column).agg(F.sum("n").alias("n")).first().n
        return n or 0

    def results(self, rules: list[DQRule], run_id: str, env: str) -> DataFrame:
        rows = [(run_id, env, r.layer, r.name, r.table, r.type, r.severity, total, failed, failed == 0) for r, total, failed in self.evaluate(rules)]
        schema = RESULT_SCHEMA.rsplit(",", 1)[0]
        return self.spark.createDataFrame(rows, schema).withColumn("checked_at", F.lit(self.stamp).cast("timestamp_ntz"))


def run_checks(evaluator: Evaluator, rules: list[DQRule], run_id: str, env: str, store: Callable[[DataFrame], None], fail_on_error: bool = True) -> dict[str, int]:
    """Evaluates, stores the results, then raises if a rule of severity error failed."""
    results = evaluator.results(rules, run_id, env)
    store(results)
    rows = results.select("rule_name", "severity", "passed").collect()
    bad = [r.rule_name for r in rows if not r.passed and r.severity == "error"]
    if bad and fail_on_error:
        raise DQError("failed rules: " + ", ".join(bad))
    return {"rules_evaluated": len(rows), "rules_failed": sum(not r.passed for r in rows)}
