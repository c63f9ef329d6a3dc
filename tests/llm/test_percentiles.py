import math
import random

from conftest import rows

from millrace.llm.percentiles import Percentiles

DDL = "g int, day int, x double, y double, n string"
P = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def data(n=700, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = rng.choice([None, float("nan"), float("inf"), -float("inf"), 3.25e200, -7.5e17, -3.5, 0.0, -0.0, *[round(rng.lognormvariate(2, 2), 2) for _ in range(12)]])
        out.append((rng.choice([1, 1, 1, 2, None]), rng.randrange(5), x, rng.choice([7.0, 7.0, 8.0]), "own"))
    out.append((3, 0, None, None, "n"))
    out.append((4, 0, 12345678.25, None, "n"))
    return out


def brute(d, col, by=0):
    groups = {}
    for r in d:
        v = r[col]
        if v is not None and not math.isnan(v):
            groups.setdefault(r[by], []).append(v)
    out = []
    for g, vs in groups.items():
        vs.sort()
        for p in P:
            out.append((g, p, vs[max(1, math.ceil(p * len(vs))) - 1] + 0.0, len(vs)))
    return sorted(out, key=repr)


def test_against_sorting(frame):
    d = data()
    p = Percentiles(["g"], ["x", "y"], P)
    got = p.resolve(p.state(frame(d, DDL)))
    for i, c in ((2, "x"), (3, "y")):
        mine, want = rows(got.filter(f"column = '{c}'"), "g", "probability", "value", "n", "error_bound"), brute(d, i)
        assert len(mine) == len(want)
        for (g, q, v, n, bound), w in zip(mine, want):
            assert (g, q, n) == (w[0], w[1], w[3]) and (v == w[2] if abs(w[2]) < 1e13 or math.isinf(w[2]) else abs(v - w[2]) <= bound < 1e-11 * abs(w[2])), (v, w)


def test_days_merge_and_every_split_gives_the_same(frame):
    d = data(seed=3)
    want = None
    for split in (2, 3, 1000):
        p = Percentiles(["g"], ["x"], P, split=split)
        f = frame(d, DDL)
        got = rows(p.resolve(p.merge(*[p.state(f.filter(f"day = {k}"), "day").drop("day") for k in range(5)])), "g", "probability", "value", "n")
        want = want or got
        assert got == want and len(got) == len(brute(d, 2))


def test_coarse_cells_keep_the_bound(frame):
    d = data(seed=4)
    p = Percentiles(["g"], ["x"], P, per_unit=2)
    exact = {(g, q): v for g, q, v, _ in brute(d, 2)}
    for g, q, v, _ in rows(p.resolve(p.state(frame(d, DDL))), "g", "probability", "value", "n"):
        assert v == exact[g, q] or abs(v - exact[g, q]) <= max(0.25, 1e-11 * abs(v)) + 1e-9


def test_empty(frame):
    p = Percentiles(["g"], ["x"], P)
    assert p.resolve(p.state(frame([], DDL))).count() == 0
