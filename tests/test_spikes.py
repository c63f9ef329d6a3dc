import random

import pytest
from conftest import rows

from millrace.operators.spikes import Reading, SpikeDetector, sparsest

DDL = "id bigint, meter string, at timestamp_ntz, a double, b double, reading string"
READINGS = [Reading("a", 0.0, 1000.0), Reading("b", 0.0, 100.0)]


def data(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        m = rng.choice(["m1", "m1", "m1", "m2", "m3"])
        base = {"m1": 10.0, "m2": 200.0, "m3": 1.0}[m]
        out.append([i, m, f"2023-01-{1 + i // 40:02d} {i % 24:02d}:{i % 60:02d}:00", round(base * rng.uniform(0.5, 2), 3), round(rng.uniform(10, 20), 3), "own"])
    return out


def detector(**k):
    return SpikeDetector("meter", "at", "id", READINGS, **k)


def runs_by_hand(rows_, col):
    out = set()
    by = {}
    for r in rows_:
        if r[1] is not None:
            by.setdefault(r[1], []).append(r)
    for own in by.values():
        own.sort(key=lambda r: (r[2] or "", r[0]))
        run = []
        for r in [*own, [None] * 6]:
            if run and (r[col] is None or r[col] != run[-1][col]):
                if len(run) >= 6:
                    out |= {x[0] for x in run}
                run = []
            if r[col] is not None:
                run.append(r)
    return out


def test_spikes_impossible_and_nulls(frame):
    d = data()
    d[10][3], d[20][3], d[30][4], d[40][3], d[50][4] = 5000.0, -1.0, float("nan"), None, 95.0
    low = next(r for r in d if r[1] == "m2" and r[0] > 60)
    low[3] = 2.0
    d.append([900, None, "2023-01-01 00:00:00", 5000.0, 15.0, "o"])
    d.append([901, None, "2023-01-01 00:00:00", 900.0, 15.0, "o"])
    d.append([902, "solo", "2023-01-01 00:00:00", 999.0, 15.0, "o"])
    got = rows(detector().flags(frame(d, DDL)), "id", "reading", "reason")
    assert got == sorted([(10, "a", "impossible"), (20, "a", "impossible"), (30, "b", "impossible"), (50, "b", "above fence"), (low[0], "a", "below fence"), (900, "a", "impossible"),
                          *[(i, c, "jump") for c, k in (("a", 3), ("b", 4)) for i in jumps_by_hand(d, k)]], key=repr)


@pytest.mark.parametrize("split", [3, 10**9])
def test_runs_with_and_without_cuts(spark, frame, split):
    d = data(300, 2)
    for start, n, v in ((5, 60, 12.5), (120, 9, 11.0), (150, 150, 9.75)):
        for r in d[start:start + n]:
            if r[1] == "m1":
                r[3] = v
    d[20][3] = None
    for r in d[200:230]:
        r[4] = 15.0
    d[0][2] = None
    det = detector(split_rows=split)
    got = sorted({(i, ["a", "b"].index(c)) for i, c in rows(det.flags(frame(d, DDL)).filter("reason = 'stuck'"), "id", "reading")}, key=repr)
    want = sorted([(i, m) for m, c in ((0, 3), (1, 4)) for i in runs_by_hand(d, c)], key=repr)
    assert want and got == want


def test_sketches_merge(frame):
    d = frame(data(), DDL)
    det = detector()
    whole = rows(det.sketch(d))
    parts = det.sketch(d.filter("id < 100")).unionByName(det.sketch(d.filter("id >= 100"))).groupBy("_src", "_ctx", "_m", "_cell").sum("n")
    assert rows(parts) == whole


def test_empty_and_repeated_rows(frame):
    assert detector().flags(frame([], DDL)).count() == 0
    d = data(100)
    d[3][3] = 9999.0
    assert rows(detector().flags(frame(d + [d[3]], DDL)), "id") == [(3,)]


def jumps_by_hand(rows_, col):
    """Positive readings JUMP times off the rows right before and after in time."""
    out, by = set(), {}
    for r in rows_:
        by.setdefault(r[1], []).append(r)
    for own in (x for m, x in by.items() if m):
        own.sort(key=lambda r: (r[2] or "", r[0]))
        for a, b, c in zip(own, own[1:], own[2:]):
            v = [x[col] for x in (a, b, c)]
            if all(x and x > 0 for x in v) and all(max(v[1] / x, x / v[1]) > 25 for x in (v[0], v[2])):
                out.add(b[0])
    return out


def test_jumps(frame):
    d = [[i, "m", f"2023-01-{1 + i // 24:02d} {i % 24:02d}:00:00", 10.0 + i % 5, 15.0, "o"] for i in range(60)]
    d[30][3] = 900.0
    d[40][3] = 0.0
    d[41][3] = 800.0  # beside a reading of zero: no rate of change can be told
    d[50][3] = None
    d[51][3] = 700.0
    d[59][3] = 900.0  # nothing follows
    got = [(i, why) for i, r, why in rows(detector().flags(frame(d, DDL)), "id", "reading", "reason") if r == "a"]
    assert got == [(30, "above fence"), (30, "jump"), (40, "below fence"), (41, "above fence"), (51, "above fence"), (59, "above fence")]


def hot(n=300):
    """A source with equal times, rows without a time, runs and jumps, whatever way it is cut."""
    d = data(n, 7)
    for r in d[50:90]:
        r[3] = 12.0
    for i in range(100, n, 9):
        d[i][3] = 9000.0 if i % 2 else 900.0
    for r in d[200:230]:
        r[2] = None
    for r in d[150:190]:
        r[2] = "2023-01-04 00:00:00"
    d[33][3], d[34][3] = None, 0.0
    return d


@pytest.mark.parametrize("split", [1, 2, 3, 5, 40])
def test_hot_source_gives_the_same_flags(frame, split):
    d = hot()
    want = rows(detector().flags(frame(d, DDL)))
    jumps = {r[0] for r in want if r[1:] == ("a", "jump")}
    assert jumps and jumps <= jumps_by_hand(d, 3)
    assert rows(detector(split_rows=split).flags(frame(d, DDL))) == want


def test_shuffled_fences_give_the_same_flags(frame, monkeypatch):
    from millrace.operators import spikes as module

    d = hot()
    want = rows(detector().flags(frame(d, DDL)))
    monkeypatch.setattr(module, "bounded_broadcast", lambda df, rows=0: df.hint("shuffle_merge"))
    assert rows(detector().flags(frame(d, DDL))) == want


def test_expansion_is_the_sparsest_place():
    assert sparsest({}) == 3.0
    assert 3.3 <= sparsest({i: 50 for i in range(0, 32)} | {45: 9}) <= 4.2
