import random

from conftest import rows

from millrace.operators.orphans import OrphanFinder, Reference

DIM = "id int, a timestamp_ntz, b timestamp_ntz"
FACT = "trip bigint, at timestamp_ntz, x int, y int, ref_field string"


def brute(facts, dims):
    out = set()
    for trip, at, x, y, _ in facts:
        for name, ref in (("x", x), ("y", y)):
            own = [d for d in dims[name] if d[0] == ref]
            if ref is None:
                continue
            if not own:
                out.add((trip, name, "missing"))
            elif at is not None:
                starts = [d[1] for d in own if d[1] is not None]
                if starts and at < min(starts):
                    out.add((trip, name, "later"))
                elif not any(d[1] is not None and d[1] <= at and (d[2] is None or at < d[2]) for d in own):
                    out.add((trip, name, "deleted"))
    return sorted(out, key=repr)


def day(n):
    return f"2023-{1 + n // 28:02d}-{1 + n % 28:02d} 10:00:00"


def test_against_brute_force(frame):
    rng = random.Random(3)
    dims = {n: [(rng.randrange(12), rng.choice([None, *[day(rng.randrange(200)) for _ in range(9)]]), rng.choice([None, day(rng.randrange(250))])) for _ in range(20)] for n in "xy"}
    facts = [(i, rng.choice([None, *[day(rng.randrange(300)) for _ in range(8)]]), rng.choice([None, 1, 1, 1, 1, *range(16)]), rng.choice([None, *range(16)]), "own") for i in range(600)]
    facts += facts[:20]
    found = OrphanFinder(frame(facts, FACT), "trip", "at", [Reference(n, frame(dims[n], DIM), "id", "a", "b") for n in "xy"])
    assert rows(found.found(), "row_id", "ref_field", "orphan_kind") == brute(facts, dims)
    assert sum(r[3] for r in rows(found.counts())) == len(brute(facts, dims))


def test_empty_target_and_facts(frame):
    ref = [Reference("x", frame([], DIM), "id", "a", "b")]
    facts = frame([(1, day(1), 5, None, "o"), (2, None, 6, None, "o"), (3, day(2), None, None, "o")], FACT)
    assert rows(OrphanFinder(facts, "trip", "at", ref).found(), "row_id", "orphan_kind") == [(1, "missing"), (2, "missing")]
    assert OrphanFinder(facts.limit(0), "trip", "at", ref).found().count() == 0
