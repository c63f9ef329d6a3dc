"""Changing tables without a table format: insert-only merge and the choice of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import bounded_broadcast


class DuplicateKeys(ValueError):
    """A stage holds a key more than once."""


def new_rows(target: DataFrame, stage: DataFrame, key: list[str]) -> DataFrame:
    """Rows of stage whose key is not in target: what an insert-only merge appends. Of target only the key is read.

    Null keys equal null keys, so a stage row with a null key is inserted once and not again.
    """
    have = target.select(*[F.col(k).alias(f"_t_{k}") for k in key])
    cond = None
    for k in key:
        c = stage[k].eqNullSafe(F.col(f"_t_{k}"))
        cond = c if cond is None else cond & c
    return stage.join(have, cond, "left_anti")


def require_unique(stage: DataFrame, key: list[str]) -> DataFrame:
    if not stage.groupBy(*key).count().filter("count > 1").isEmpty():
        raise DuplicateKeys(f"the stage repeats a key of {key}")
    return stage


def merge_insert(target: DataFrame, stage: DataFrame, key: list[str]) -> DataFrame:
    """The target after the merge: existing rows win."""
    return target.unionByName(new_rows(target, require_unique(stage, key), key))


def unprocessed(rows: DataFrame, done: DataFrame, file: str = "_source_file") -> DataFrame:
    """Rows of files that are not among the done ones; rows without a file are never done. The file list is broadcast if it was counted small."""
    names = bounded_broadcast(done.select(F.col(file).alias("_done")).distinct())
    return rows.join(names, rows[file] == F.col("_done"), "left_anti")


def processed_files(*tables: DataFrame, file: str = "_source_file") -> DataFrame:
    """The distinct files of several tables."""
    out = tables[0].select(file)
    for t in tables[1:]:
        out = out.unionByName(t.select(file))
    return out.distinct()
