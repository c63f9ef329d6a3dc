import random

from conftest import rows
from pyspark.sql import functions as F

from millrace.operators.asof import AsOf, Versions

VERSIONS = Versions("k", "f", "t", "v")
DDL = "v int, k int, name string, f timestamp_ntz, t timestamp_ntz, extra string"
EVENTS = "id bigint, k int, at timestamp_ntz, name string"


def stamp(h, s=0):
    return f"2023-01-{1 + h // 24:02d} {h % 24:02d}:{s // 60:02d}:{s % 60:02d}"


def brute(versions, events):
    out = []
    for i, k, at, _ in events:
        live = [x for x in versions if k is not None and at is not None and x[1] == k and x[3] is not None and x[3] <= at and (x[4] is None or at < x[4])]
        out.append((i, max(live, key=lambda x: (x[3], x[0]))[0] if live else None))
    return sorted(out, key=repr)


def test_against_brute_force(frame):
    rng = random.Random(5)
    versions = []
    for v in range(60):
        a, b = rng.randrange(600), rng.randrange(600)
        versions.append((v, rng.randrange(4), f"n{v}", stamp(a, rng.randrange(3600)), rng.choice([None, stamp(a + b % 90, rng.randrange(3600)), stamp(a)]), "x"))
    versions += versions[:5]
    events = [(i, rng.choice([0, 1, 2, 3, 9, None]), rng.choice([None] + [stamp(rng.randrange(700), rng.randrange(3600)) for _ in range(9)]), "e") for i in range(800)]
    events += [(900 + i, x[1], x[3], "e") for i, x in enumerate(versions)]  # exactly at a start
    events += [(2000 + i, x[1], x[4], "e") for i, x in enumerate(versions)]  # exactly at an end
    events += [(3000, 0, "1999-01-01 00:00:00", "e"), (3001, 0, "2048-01-01 00:00:00", "e")]
    asof = AsOf(frame(versions, DDL), VERSIONS, ["name"])
    out = asof.enrich(frame(events, EVENTS), "k", "at")
    assert set(out.columns) == {"id", "k", "at", "name", "v", "asof_name"}  # the event's own name stays
    assert rows(out, "id", "v") == brute(versions, events)
    assert rows(out.filter("v is not null").filter(F.col("asof_name") != F.concat(F.lit("n"), F.col("v"))), "id") == []


def test_empty_tables(frame):
    none = AsOf(frame([], DDL), VERSIONS, ["name"])
    events = frame([(1, 1, stamp(1), "e"), (2, None, None, None)], EVENTS)
    assert rows(none.enrich(events, "k", "at"), "id", "v") == [(1, None), (2, None)]
    some = AsOf(frame([(1, 1, "a", stamp(0), None, "x")], DDL), VERSIONS, ["name"])
    assert some.enrich(frame([], EVENTS), "k", "at").count() == 0


def test_repeated_events_stay(frame):
    asof = AsOf(frame([(1, 1, "a", stamp(0), None, "x")] * 3, DDL), VERSIONS, ["name"])
    assert rows(asof.enrich(frame([(1, 1, stamp(5), "e")] * 2, EVENTS), "k", "at"), "id", "v") == [(1, 1), (1, 1)]


def test_withdrawn_version_is_newest_but_never_valid(frame):
    asof = AsOf(frame([(1, 1, "a", stamp(0), None, "x"), (2, 1, "b", stamp(9), stamp(9), "x")], DDL), VERSIONS, ["name"])
    assert rows(asof.newest()) == [(1, 2)]
    assert rows(asof.enrich(frame([(1, 1, stamp(9), "e")], EVENTS), "k", "at"), "v") == [(1,)]


def test_shuffled_join_gives_the_same(frame, monkeypatch):
    from millrace.operators import asof as module

    versions = frame([(v, v % 3, f"n{v}", stamp(v * 5), stamp(v * 5 + 7), "x") for v in range(30)], DDL)
    events = frame([(i, i % 4, stamp(i * 2), "e") for i in range(100)], EVENTS)
    want = rows(AsOf(versions, VERSIONS, ["name"]).enrich(events, "k", "at"))
    monkeypatch.setattr(module, "bounded_broadcast", lambda df, rows=0: df.hint("shuffle_merge"))
    assert rows(AsOf(versions, VERSIONS, ["name"]).enrich(events, "k", "at")) == want


def test_no_event_is_lost_at_either_end_of_time(frame):
    asof = AsOf(frame([(1, 1, "a", stamp(0), "9999-12-31 23:00:00", "x"), (2, 2, "b", "0001-01-01 00:00:00", None, "x"), (3, 3, "c", stamp(3), stamp(4), "x")], DDL), VERSIONS, ["name"])
    times = ["-0044-03-15 00:00:00", "0001-01-01 00:00:00", stamp(3), "9999-12-31 01:00:00", "9999-12-31 23:30:00", "+12024-01-01 00:00:00"]
    events = [(10 * k + i, k, t, "e") for k in (1, 2, 3) for i, t in enumerate(times)]
    got = dict(rows(asof.enrich(frame(events, EVENTS), "k", "at"), "id", "v"))
    assert got == {10: None, 11: None, 12: 1, 13: 1, 14: None, 15: None, 20: None, 21: 2, 22: 2, 23: 2, 24: 2, 25: 2, 30: None, 31: None, 32: 3, 33: None, 34: None, 35: None}
