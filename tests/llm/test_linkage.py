import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.llm import linkage
from millrace.session import Scratch

DDL = ("trip_id bigint, meter_id string, vendor_id int, pickup_ts timestamp_ntz, dropoff_ts timestamp_ntz, trip_distance double, fare_amount double, total_amount double, "
       "pickup_zone_id int, dropoff_zone_id int, trip_hash string, _source_file string, _ingested_at timestamp_ntz, id string, rep string")


def t(day, sec):
    return f"2023-0{1 + day // 28}-{1 + day % 28:02d} {sec // 3600:02d}:{sec // 60 % 60:02d}:{sec % 60:02d}"


def hashed(r):
    return "|".join(map(str, (r["v"], r["p"], r["q"], r["pz"], r["dz"], r["total"])))


def make(seed=1, n=150):
    """Rides over three files, a part delivered again unchanged or changed in a few fields, and look-alikes of other meters."""
    rng = random.Random(seed)
    out, pairs, no = [], set(), 0

    def add(r, file):
        nonlocal no
        no += 1
        out.append((no, r["m"], r["v"], t(r["d"], r["p"]), t(r["d"], r["q"]), r["dist"], r["fare"], r["total"], r["pz"], r["dz"], hashed(r), f"f{file}", f"2023-0{file + 5}-01 00:00:00", "own", "own"))
        return no

    for _ in range(n):
        p = rng.randrange(4000, 80000)
        dist = round(rng.uniform(0.5, 20), 2)
        r = dict(m=f"M00-{rng.randrange(1, 40):05d}", v=rng.choice([1, 2]), d=rng.randrange(50), p=p, q=p + rng.randrange(200, 3000), dist=dist, fare=round(3 + 2.3 * dist, 2),
                 total=0.0, pz=rng.randrange(1, 60), dz=rng.randrange(1, 60))
        r["total"] = round(r["fare"] + rng.uniform(1, 9), 2)
        first = add(r, 1)
        if rng.random() < 0.2:  # a look-alike of another meter in the same minute
            s = dict(r, m="M00-00077", p=p - p % 60 + 7, dist=round(dist * 1.2, 2), fare=round(r["fare"] * 1.15, 2), total=round(r["total"] * 1.1, 2), q=r["q"] + 9)
            add(s, 2)
        if rng.random() < 0.6:
            s = dict(r)
            kind = rng.choice(["same", "minute", "hour", "tip", "vendor", "zone", "lost", "spelled", "round"])
            if kind == "minute":
                s["p"], s["q"] = s["p"] - s["p"] % 60, s["q"] - s["q"] % 60
            elif kind == "hour":
                s["p"], s["q"] = s["p"] + 3600, s["q"] + 3600
            elif kind == "tip":
                s["total"] = round(s["total"] + 2, 2)
            elif kind == "vendor":
                s["v"] = 3 - s["v"]
            elif kind == "zone":
                s["dz"] = s["dz"] + 100
            elif kind == "lost":
                s["m"] = None
            elif kind == "spelled":
                s["m"] = "m00/" + s["m"][4:].lstrip("0")
            elif kind == "round":
                s["dist"] = round(s["dist"], 1)
            second = add(s, 2)
            pairs.add((first, second))
            if rng.random() < 0.2:
                third = add(s, 3)
                pairs |= {(first, third), (second, third)}
    return out, {(min(p), max(p)) for p in pairs}


def found(spark, df, files=linkage.FILES_PER_BATCH):
    return {tuple(r) for r in linkage.Linker(spark).replay(df, files).pairs().collect()}


def test_finds_the_planted_pairs(spark, frame):
    data, pairs = make()
    got = found(spark, frame(data, DDL))
    assert len(got & pairs) >= 0.97 * len(pairs) and len(got - pairs) <= 0.02 * len(pairs)


def test_any_number_of_files_a_batch_gives_the_same(spark, frame):
    df = frame(make(2, 100)[0], DDL)
    assert found(spark, df, 1) == found(spark, df, 2) == found(spark, df, 3)


def test_nothing_changes_where_nothing_may_be_broadcast(spark, frame, monkeypatch):
    df = frame(make(3, 60)[0], DDL)
    want = found(spark, df, 2)
    monkeypatch.setattr(linkage, "FETCH_ROWS", -1)
    monkeypatch.setattr(linkage, "bounded_broadcast", lambda df, rows=0: df.hint("shuffle_merge"))
    assert want and found(spark, df, 2) == want


def numbered(frame, data):
    """One file's rides, as `accept` takes them."""
    return linkage.rides(frame(data, DDL))


def ride(no, meter="M00-00001", sec=5000, file="f1", **k):
    r = dict(day=1, dist=2.0, fare=9.0, total=12.0, pz=5, dz=6, hash="h") | k
    times = (t(r["day"], sec), t(r["day"], sec + 900)) if sec is not None else (None, None)
    return (no, meter, 1, *times, r["dist"], r["fare"], r["total"], r["pz"], r["dz"], r["hash"], file, "2023-11-01 00:00:00", "o", "o")


def test_a_batch_gives_its_own_links_only_and_touches_their_clusters_only(spark, frame, tmp_path):
    k = linkage.Linker(spark, str(tmp_path / "store"))
    two = dict(sec=9000, dist=7.5, fare=20.0, total=25.0, pz=8, dz=9, hash="g")
    links = lambda data, name: sorted(tuple(r) for r in k.accept(numbered(frame, data), name).collect())
    log = lambda at: k.store.read(linkage.CLUSTERS).filter(f"at = {at}").count()
    assert links([ride(1), ride(2, "M00-00002", **two)], "one") == []
    assert links([ride(3, "m00/1"), ride(4, None, **two)], "two") == [(1, 3), (2, 4)] and log(2) == 4
    assert links([ride(5, "M00-00009", 50000, dist=3.3, fare=14.0, total=18.0, hash="x")], "three") == [] and log(3) == 0  # same month, other ride
    before = k.store.count(linkage.CLUSTERS)
    assert links([ride(3, "m00/1"), ride(4, None, **two)], "two") == [(1, 3), (2, 4)]  # the same batch again
    assert k.store.count(linkage.CLUSTERS) == before and len(k._log()) == 3
    assert links([ride(6)], "four") == [(1, 6), (3, 6)] and log(4) == 1  # the cluster's other members stay as they are
    assert dict(rows(k.clusters(), "id", "rep")) == {1: 1, 3: 1, 6: 1, 2: 2, 4: 2}
    assert rows(k.pairs()) == [(1, 3), (1, 6), (2, 4), (3, 6)]
    again = linkage.Linker(spark, str(tmp_path / "store"))
    assert again.weights() == k.weights() and again.weights().m["meter"][0] > 0.5


def test_a_link_between_old_clusters_joins_all_their_members(spark, frame):
    k = linkage.Linker(spark)
    none = numbered(frame, []).limit(0).select(F.col("id").alias("a"), "id", "seq", "meter", "p")
    w = linkage.fit([])

    def cluster(number, links):
        node = lambda s: f"named_struct('seq', {s}, 'meter', 'm', 'p', 5L)"
        df = spark.createDataFrame([(a, b, s, z) for a, s, b, z in links], "a bigint, b bigint, s int, z int").selectExpr(
            "a", "b", f"{node('s')} x", f"{node('z')} y", "true copy", *[f"0 {f}" for f in linkage.LEVELS])
        k._cluster(df, none, w, number, F.lit(True), Scratch(spark, "t"))

    cluster(1, [(1, 1, 2, 2), (5, 1, 6, 2)])
    cluster(2, [(2, 2, 7, 3), (6, 2, 7, 3)])
    last = k.store.read(linkage.CLUSTERS).groupBy("id").agg(F.max_by("rep", "at").alias("r")).select("id", "r.id")
    assert {tuple(r) for r in last.collect()} == {(i, 1) for i in (1, 2, 5, 6, 7)}


def test_deliveries_without_a_time(spark, frame):
    a, b = ride(1, sec=None), ride(2, sec=None, file="f2", total=13.0)
    c, d = ride(3, "M00-00002", None, dist=4.0, fare=11.0, hash="z"), ride(4, None, None, "f2", dist=4.0, fare=11.0, hash="z")
    other = ride(5, "M00-00003", None, "f2", hash="h")
    later = [(*x[:12], "2023-12-01 00:00:00", "o", "o") for x in (b, d, other)]
    assert found(spark, frame([a, c, *later], DDL)) == {(1, 2), (3, 4)}


def test_a_digest_knows_which_field_is_null(spark, frame):
    x, y = numbered(frame, [ride(1, pz=None, dz=5), ride(2, pz=5, dz=None)]).orderBy("id").collect()
    assert (x.d1, x.d2) != (y.d1, y.d2)


def test_ranges():
    assert linkage.ranges([]) == [] and linkage.ranges([(10, 20), (30, 40)]) == [(10 - linkage.FARTHEST, 40 + linkage.FARTHEST)]
    rng = random.Random(4)
    spans = [(x, x + 5) for x in (rng.randrange(10**9) for _ in range(500))]
    got = linkage.ranges(spans)
    assert len(got) <= linkage.MOST_RANGES and all(any(lo <= a - linkage.FARTHEST and b + linkage.FARTHEST <= hi for lo, hi in got) for a, b in spans)
    assert sorted(got) == got and all(x[1] < y[0] for x, y in zip(got, got[1:]))


def test_copies_ties_nulls_and_empty(spark, frame):
    base = (1, "M00-00001", 1, t(1, 5000), t(1, 6000), 2.0, 9.0, 12.0, 5, 6, "h", "f1", "2023-11-01 00:00:00", "o", "o")
    again = [(i, *base[1:11], "f2", "2023-12-01 00:00:00", "o", "o") for i in (2, 3)]
    blank = [(i, *[None] * 10, f, at, None, None) for i, f, at in ((8, "f1", "2023-11-01 00:00:00"), (9, "f2", "2023-12-01 00:00:00"))]
    got = found(spark, frame([base, base, *again, *blank], DDL))
    assert {(1, 2), (1, 3)} <= got and (2, 3) not in got and all(a != b for a, b in got)
    assert found(spark, frame([], DDL)) == set()


def test_different_meters_never_link(spark, frame):
    a = (1, "M00-00001", 1, t(1, 5000), t(1, 6000), 2.0, 9.0, 12.0, 5, 6, "h", "f1", "2023-11-01 00:00:00", "o", "o")
    b = (2, "M00-00002", *a[2:11], "f2", "2023-12-01 00:00:00", "o", "o")
    assert found(spark, frame([a, b], DDL)) == set()


@pytest.mark.parametrize("size", [1, 40])
def test_union_find_on_a_chain(spark, frame, size):
    chain = list(range(size + 1))
    random.Random(1).shuffle(chain)
    edges = frame(list(zip(chain, chain[1:])) + [(100, 101)], "a bigint, b bigint")
    got = dict(rows(linkage.union_find(edges, Scratch(spark, "t"))))
    assert got == {**{i: 0 for i in range(size + 1)}, 100: 100, 101: 100}


def test_canonical_meter(spark, frame):
    df = frame([("M00-00199",), ("m00/199",), (" m00 0199",), ("",), (None,), ("M01-00199",)], "meter_id string")
    assert [r[0] for r in df.select(linkage.canonical_meter("meter_id")).collect()] == ["M00-199"] * 3 + [None, None, "M01-199"]
