import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.operators import history
from millrace.operators.history import Snapshots, build_history, change_events, latest_per_snapshot

DDL = "snap date, k int, a string, b string, at timestamp_ntz, valid_to string"


def snaps(frame, data):
    return latest_per_snapshot(frame(data, DDL), "snap", "k", ["a", "b"], "at")


def row(m, k, a, b=None, at=1):
    return (f"2023-{m:02d}-01", k, a, b, f"2023-{m:02d}-{at:02d} 00:00:00", "own")


def test_changes_absence_and_nulls(frame):
    data = [row(1, 1, "x"), row(2, 1, "x"), row(3, 1, None), row(4, 1, None), row(1, 2, "q"), row(3, 2, "q"), row(4, 2, "q"), row(1, 3, "n", "m"), row(2, 3, "m", "n"), row(3, 3, "m", "n"), row(2, 4, "z")]
    h = build_history(snaps(frame, data), "snap", "k", ["a", "b"])
    assert rows(h, "k", "a", "valid_from", "valid_to") == sorted([
        (1, "x", "2023-01-01", "2023-03-01"), (1, None, "2023-03-01", "None"), (2, "q", "2023-01-01", "2023-02-01"), (2, "q", "2023-03-01", "None"),
        (3, "n", "2023-01-01", "2023-02-01"), (3, "m", "2023-02-01", "2023-04-01"), (4, "z", "2023-02-01", "2023-03-01")], key=repr) or \
        rows(h.fillna("None", ["a"]).selectExpr("k", "a", "string(valid_from) f", "coalesce(string(valid_to), 'None') t")) == sorted([
            (1, "x", "2023-01-01", "2023-03-01"), (1, "None", "2023-03-01", "None"), (2, "q", "2023-01-01", "2023-02-01"), (2, "q", "2023-03-01", "None"),
            (3, "n", "2023-01-01", "2023-02-01"), (3, "m", "2023-02-01", "2023-04-01"), (4, "z", "2023-02-01", "2023-03-01")], key=repr)
    kinds = rows(change_events(snaps(frame, data), "snap", "k", ["a", "b"]), "k", "snap", "change")
    assert (3, "2023-04-01", "deleted") in kinds and (1, "2023-03-01", "changed") in kinds and (2, "2023-03-01", "inserted") in kinds


def test_last_arrival_wins_and_ties_are_decided(frame):
    data = [row(1, 1, "old", at=1), row(1, 1, "new", at=2), row(1, 2, "a"), row(1, 2, "b"), (None, 1, "x", None, None, ""), row(1, None, "x")]
    assert rows(snaps(frame, data), "k", "a") == [(1, "new"), (2, "b")]


def test_empty(frame):
    assert build_history(snaps(frame, []), "snap", "k", ["a", "b"]).count() == 0


def drawn(n, repeats, seed=1):
    """Snapshots of few keys with nulls, blanks, late and repeated rows, ties and absences."""
    rng = random.Random(seed)
    out = [(None, 1, "x", None, None, ""), row(1, None, "x"), row(2, 1, "x", "y")]
    for _ in range(n):
        m, k = rng.randrange(1, 9), rng.randrange(12)
        if (m + k) % 5:
            out += [row(m, k, rng.choice([None, "", "x", " x", "y"]), rng.choice([None, "p", "q"]), rng.choice([1, 1, 2])) for _ in range(rng.randrange(1, repeats + 1))]
    return out + [("2023-03-01", 5, "z", "z", None, "own")]


@pytest.mark.parametrize("coded,repeats,combine", [(0, 1, 1e9), (0, 5, 0.0), (100_000, 5, 1e9), (100_000, 1, 0.0)])
def test_snapshots_give_what_the_functions_give(frame, monkeypatch, coded, repeats, combine):
    monkeypatch.setattr(history, "CODED", coded)
    monkeypatch.setattr(history, "REPEATS", combine)
    f, clean = frame(drawn(120, repeats), DDL), lambda c: F.nullif(F.btrim(c), F.lit(""))
    s = Snapshots(f, "snap", "k", ["a", "b"], "at", clean)
    assert (s.names is None) == (coded == 0)
    want = latest_per_snapshot(f.withColumns({c: clean(F.col(c)) for c in "ab"}), "snap", "k", ["a", "b"], "at")
    assert rows(s.changes(), "snap", "k", "a", "b", "change") == rows(change_events(want, "snap", "k", ["a", "b"]), "snap", "k", "a", "b", "change") != []
    assert rows(s.history(), "k", "a", "b", "valid_from", "valid_to") == rows(build_history(want, "snap", "k", ["a", "b"]), "k", "a", "b", "valid_from", "valid_to")


def test_tables_of_numbers_that_are_too_large_are_not_used(frame, monkeypatch):
    monkeypatch.setattr(history, "bounded_broadcast", lambda df: df)
    f = frame(drawn(60, 2), DDL)
    s = Snapshots(f, "snap", "k", ["a", "b"], "at")
    assert s.names is None and rows(s.history()) == rows(build_history(latest_per_snapshot(f, "snap", "k", ["a", "b"], "at"), "snap", "k", ["a", "b"]))


def test_rows_of_snapshots_are_shuffled_once(spark, frame, monkeypatch):
    monkeypatch.setattr(history, "REPEATS", 1e9)
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    s, before = Snapshots(frame(drawn(60, 1), DDL), "snap", "k", ["a", "b"], "at"), spark.conf.get(setting)
    with history._join_in_place(spark):
        plan = change_events(s.latest, "snap", "k", s.carried, s.days, True)._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get(setting) == before
    # both sides of the join are read from one exchange of the same columns, none of them text
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == plan.count("REPARTITION_BY_COL") == 2
    assert "FullOuter" in plan and "SortAggregate" not in plan


def test_empty_snapshots(frame):
    s = Snapshots(frame([], DDL), "snap", "k", ["a", "b"], "at")
    assert s.history().count() == 0 and s.changes().count() == 0


def test_null_keys_are_one_key(frame):
    f = frame([row(1, None, "x"), row(2, None, "y"), row(3, 1, "z")], DDL).select("snap", "k", "a")
    assert rows(change_events(f, "snap", "k", ["a"]), "snap", "k", "change") == sorted([
        ("2023-01-01", None, "inserted"), ("2023-02-01", None, "changed"), ("2023-03-01", None, "deleted"), ("2023-03-01", 1, "inserted")], key=repr)
