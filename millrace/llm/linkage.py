"""Deduplicating new batches against all history: incremental record linkage.

Every accepted record stays in a persisted table from which its blocking keys are made. A batch probes
the part of that table that lies near its own times, candidate pairs are scored with learned weights (a
two-class mixture over levels of agreement, fitted by expectation maximisation on the pattern counts of
all batches so far, which are stored with the tables), and accepted links update the representative
mappings of the affected clusters by union-find. Exact copies inside a batch collapse to one record before
any key is emitted, so a group of copies costs one row per key however large it is.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.times import epoch_seconds
from millrace.session import Scratch, bounded_broadcast
from millrace.store import Store

#: Records of a batch from which known non-matches are taken, about.
TRAIN_ROWS = 20_000
#: Candidate ids, or keys of records without a meter, that may be broadcast (two or three longs each).
FETCH_ROWS = 1_000_000
#: A pair is linked if the fitted probability reaches this.
THRESHOLD = 0.5
#: Two deliveries of one ride start at most this far apart (seconds); alike rides further apart are different rides.
FARTHEST = 7200
#: The times of a batch are summed up in at most so many ranges, by which history is pruned.
MOST_RANGES = 32
#: Files that are taken in together where several wait.
FILES_PER_BATCH = 8


def canonical_meter(c: str | Column) -> Column:
    """A meter id without differences of case, separator and leading zeros of its number; null for null or blank."""
    c = F.col(c) if isinstance(c, str) else c
    up = F.regexp_replace(F.upper(F.trim(c)), "[^A-Z0-9]+", "-")
    return F.nullif(F.regexp_replace(up, "-0+(?=[0-9])", "-"), F.lit(""))


FIELDS = ["meter", "p", "q", "dist", "fare", "total", "pz", "dz", "vendor", "hash"]


def rides(df: DataFrame) -> DataFrame:
    """The fields that linkage compares, under private names, and a digest of them all (with the place of each null);
    `seq` numbers files in order of arrival."""
    files = df.groupBy("_source_file").agg(F.min("_ingested_at").alias("_at"))
    order = files.select(F.col("_source_file").alias("_f"), F.row_number().over(Window.orderBy("_at", "_source_file")).alias("seq"))
    out = df.select(
        F.col("trip_id").alias("id"), F.col("_source_file").alias("file"), canonical_meter("meter_id").alias("meter"),
        epoch_seconds("pickup_ts").alias("p"), epoch_seconds("dropoff_ts").alias("q"),
        F.col("trip_distance").cast("double").alias("dist"), F.col("fare_amount").cast("double").alias("fare"),
        F.col("total_amount").cast("double").alias("total"), F.col("pickup_zone_id").alias("pz"), F.col("dropoff_zone_id").alias("dz"),
        F.col("vendor_id").alias("vendor"), F.col("trip_hash").alias("hash"),
    ).join(bounded_broadcast(order), F.col("file").eqNullSafe(F.col("_f")), "left").drop("_f", "file")
    nulls = F.concat(*[F.when(F.col(f).isNull(), "1").otherwise("0") for f in FIELDS])
    return out.withColumns({"d1": F.xxhash64(nulls, *FIELDS), "d2": F.xxhash64(F.lit("second"), nulls, *FIELDS)})


def _windows(seconds: Column, width: int) -> list[Column]:
    """Two overlapping time buckets: times less than width / 2 apart share at least one."""
    return [F.floor(seconds / width), F.floor((seconds + width // 2) / width)]


def _key(name: str, *parts: Column) -> Column:
    known = parts[0].isNotNull()
    for x in parts[1:]:
        known = known & x.isNotNull()
    return F.when(known, F.xxhash64(F.lit(name), *parts))


def metered_keys() -> Column:
    """Keys under which two deliveries with the same meter meet; a changed time or a changed value hides one of them only.
    Deliveries without a time meet by trip hash, exact copies that lack a time or a meter by their digest."""
    m, p = F.col("meter"), F.col("p")
    w = _windows(p, 2 * FARTHEST)
    return F.array_compact(F.array(
        _key("minute", m, F.floor(p / 60)), F.when(p.isNull(), _key("timeless", m, F.col("hash"))),
        F.when(p.isNull() | m.isNull(), _key("copy", F.col("d1"), F.col("d2"))), *[_key(f"value{i}", m, F.col("dist"), F.col("fare"), b) for i, b in enumerate(w)]))


def unmetered_keys() -> Column:
    """Keys under which a delivery that lost its meter meets the other one."""
    w = _windows(F.col("p"), 2 * FARTHEST)
    return F.array_compact(F.array(
        _key("hash", F.col("hash")), _key("times", F.col("p"), F.col("q")),
        _key("place", F.floor(F.col("p") / 60), F.col("pz"), F.round(F.col("dist"), 0)),
        *[_key(f"fares{i}", F.col("dist"), F.col("fare"), F.col("pz"), b) for i, b in enumerate(w)]))


def _near(f: str, exact: float, close: float) -> Column:
    d = F.abs(F.col(f"x.{f}") - F.col(f"y.{f}"))
    return F.when(d.isNull(), 3).when(d <= exact, 0).when(d <= close, 1).otherwise(2)


def _same(f: str) -> Column:
    return F.when(F.col(f"x.{f}").isNull() | F.col(f"y.{f}").isNull(), 3).when(F.col(f"x.{f}") == F.col(f"y.{f}"), 0).otherwise(2)


def comparison() -> dict[str, Column]:
    """Level of agreement of each field, 0 best; 3 where a side is null."""
    dp, dq = F.col("y.p") - F.col("x.p"), F.col("y.q") - F.col("x.q")
    minute = (F.floor(F.col("x.p") / 60) == F.floor(F.col("y.p") / 60)) & (F.floor(F.col("x.q") / 60) == F.floor(F.col("y.q") / 60))
    trunc = minute & (((F.col("x.p") % 60 == 0) & (F.col("x.q") % 60 == 0)) | ((F.col("y.p") % 60 == 0) & (F.col("y.q") % 60 == 0)))
    time = (F.when(dp.isNull() | dq.isNull(), 5).when((dp == 0) & (dq == 0), 0).when((dp == 0) | (dq == 0), 1).when(trunc, 2)
            .when((dp == dq) & (F.abs(dp) <= FARTHEST), 3).when(F.abs(dp) <= FARTHEST, 4).otherwise(6))
    # distance, fare and total change together (a rounded delivery changes all three), so they are one level
    near = {f: _near(f, 1e-9, close) for f, close in (("dist", 0.051), ("fare", 0.51), ("total", 0.51))}
    own = (near["dist"] == 0) & (near["fare"] == 0)
    value = (F.when((near["dist"] == 3) | (near["fare"] == 3), 5).when(own & (near["total"] == 0), 0).when(own, 1)
             .when((near["dist"] <= 1) & (near["fare"] <= 1), 2).when((near["dist"] <= 1) | (near["fare"] <= 1), 3).otherwise(4))
    return {"meter": _same("meter"), "time": time, "value": value, "pz": _same("pz"), "dz": _same("dz"), "vendor": _same("vendor")}


@dataclass(frozen=True)
class Weights:
    """P(level | match), P(level | no match) per field, and the share of matches; fitted by `fit`."""

    m: dict[str, dict[int, float]]
    u: dict[str, dict[int, float]]
    prior: float

    def text(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def of(text: str) -> "Weights":
        d = json.loads(text)
        m, u = ({f: {int(k): v for k, v in ls.items()} for f, ls in d[side].items()} for side in "mu")
        return Weights(m, u, d["prior"])

    def log_odds(self) -> Column:
        out = F.lit(math.log(self.prior / (1 - self.prior)))
        for f in self.m:
            w = F.lit(0.0)
            for level in self.m[f]:
                w = F.when(F.col(f) == level, math.log(self.m[f][level] / self.u[f][level])).otherwise(w)
            out = out + w
        return out


def label() -> Column:
    """1 for pairs that are known to match (same trip hash and meter), 0 for known different meters, else null."""
    return F.when((F.col("x.hash") == F.col("y.hash")) & (F.col("x.meter") == F.col("y.meter")), 1).when(F.col("x.meter") != F.col("y.meter"), 0)


LEVELS = {"meter": (0, 2, 3), "time": (0, 1, 2, 3, 4, 5, 6), "value": (0, 1, 2, 3, 4, 5), "pz": (0, 2, 3), "dz": (0, 2, 3), "vendor": (0, 2, 3)}


def fit(patterns: list[tuple[dict[str, int], int | None, int]], rounds: int = 30) -> Weights:
    """Expectation maximisation over (levels, label or None, count). Counts of patterns stand for all pairs; the
    number of patterns is bounded by the product of the levels. Labels stay fixed; smoothing keeps levels that
    were never seen possible."""
    resp = []
    for levels, label, _ in patterns:
        agree = sum(levels[f] == 0 for f in LEVELS) / len(LEVELS)
        resp.append(float(label) if label is not None else agree)
    weights = None
    for _ in range(rounds):
        m, u, total = {}, {}, [0.0, 0.0]
        for f, ls in LEVELS.items():
            m[f], u[f] = {x: 0.5 for x in ls}, {x: 0.5 for x in ls}
        for (levels, _, n), r in zip(patterns, resp):
            total[1] += r * n
            total[0] += (1 - r) * n
            for f in LEVELS:
                m[f][levels[f]] += r * n
                u[f][levels[f]] += (1 - r) * n
        for side in (m, u):
            for f in LEVELS:
                t = sum(side[f].values())
                side[f] = {x: c / t for x, c in side[f].items()}
        prior = min(0.99, max(0.01, (total[1] + 1) / (sum(total) + 2)))
        weights = Weights(m, u, prior)
        resp = []
        for levels, label, _ in patterns:
            if label is not None:
                resp.append(float(label))
                continue
            z = math.log(prior / (1 - prior)) + sum(math.log(m[f][levels[f]] / u[f][levels[f]]) for f in LEVELS)
            resp.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
    return weights or Weights({f: {x: 1 / len(ls) for x in ls} for f, ls in LEVELS.items()}, {f: {x: 1 / len(ls) for x in ls} for f, ls in LEVELS.items()}, 0.5)


def chance_pairs(records: DataFrame, n: int) -> DataFrame:
    """Pairs of records of different meters that start in one minute at one place: they are known not to match.

    Taken from about TRAIN_ROWS of n records, by a digest of minute and place, so both records of a pair are in it or none.
    """
    place = F.xxhash64(F.floor(F.col("p") / 60), F.col("pz"), F.col("dz"))
    part = records.filter("meter IS NOT NULL").withColumn("place", F.when(F.col("p").isNotNull() & F.col("pz").isNotNull(), place)).filter(
        F.pmod(F.col("place"), F.lit(max(1, n // TRAIN_ROWS))) == 0)
    # neighbours in a block are enough: no block is expanded into all its pairs
    w = Window.partitionBy("place").orderBy("meter", "id")
    x = part.select("place", F.struct(*FIELDS).alias("y"), F.lag(F.struct(*FIELDS)).over(w).alias("x"))
    return x.filter("x IS NOT NULL AND x.meter <> y.meter").select("x", "y")


def union_find(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, rep) of every node that an edge (a, b) touches: the smallest node of its component. Nodes may be of any ordered type.

    Each round a node takes the smallest representative among its neighbours and then that
    representative's own (pointer jumping), so the rounds grow with the logarithm of a component's
    diameter; each round is a written table.
    """
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("other"))).distinct()
    label = scratch.write(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("rep")), "label0")
    n = 0
    while True:
        seen = both.join(label.select(F.col("id").alias("other"), F.col("rep").alias("r")), "other").groupBy("id").agg(F.min("r").alias("r"))
        step = label.join(seen, "id").select("id", F.least("rep", "r").alias("rep"), F.col("rep").alias("was"))
        jump = step.select(F.col("id").alias("j"), F.col("rep").alias("jr"))
        new = step.join(jump, F.col("rep") == F.col("j"), "left").select("id", F.least("rep", F.coalesce("jr", "rep")).alias("rep"), "was")
        n += 1
        new = scratch.write(new, f"label{n}")
        label = new.select("id", "rep")
        if new.filter("rep <> was").isEmpty():
            return label
        if n > 1:
            scratch.drop(f"label{n - 2}")


def ranges(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans widened by FARTHEST and joined where they touch; the narrowest gaps are closed until MOST_RANGES are left."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo - FARTHEST <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + FARTHEST)
        else:
            out.append([lo - FARTHEST, hi + FARTHEST])
    if len(out) > MOST_RANGES:
        wide = sorted(sorted(range(1, len(out)), key=lambda i: out[i - 1][1] - out[i][0])[: MOST_RANGES - 1])  # the widest gaps stay
        out = [[out[i][0], out[j - 1][1]] for i, j in zip([0, *wide], [*wide, len(out)])]
    return [(lo, hi) for lo, hi in out]


RECORDS, LINKS, CLUSTERS, BATCHES = "linkage.records", "linkage.links", "linkage.clusters", "linkage.batches"
_BATCH = "number int, name string, last_seq int, bare bigint, weights string, patterns string"


class Linker:
    """Links deliveries across batches, against tables under one root folder that every batch extends.

    Defined results: repeated rows (same id and fields) count once; deliveries without a time meet by
    trip hash, where both have a meter it must be the same; null fields neither speak for nor against a pair
    by themselves; exact copies from different files always link, copies inside a file are one cluster; two
    records of one file are never a pair; a batch that was accepted before adds nothing and gives its links
    again; a batch that broke off is written anew. The representative of a cluster is the record that was
    accepted first, of those of one file the smallest id. An empty table gives no pairs. One writer per
    root is assumed.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.scratch = spark, Scratch(spark, "linkage")
        self.store = Store(spark, root or f"{self.scratch.root}/store")

    # ---- what history holds ----

    def _log(self) -> list:
        """Accepted batches in order: the last one's weights, and pattern counts of all (both bounded by the levels)."""
        return self.store.read(BATCHES).orderBy("number").collect() if self.store.exists(BATCHES) else []

    def _history(self, table: str, number: int, near: Column) -> DataFrame | None:
        """Rows of earlier batches near the batch's times. Records are sorted by time in each file, so the ranges skip row groups and pages."""
        return self.store.read(table).filter((F.col("at") < number) & near) if number > 1 else None

    def weights(self) -> Weights:
        return Weights.of(self._log()[-1].weights)

    def clusters(self) -> DataFrame:
        """(id, seq, meter, rep) of every record that is in a cluster; the last entry of an id holds."""
        if not self.store.exists(CLUSTERS):
            return self.spark.createDataFrame([], "id bigint, seq int, meter string, rep bigint")
        last = F.max_by(F.struct("seq", "meter", "rep"), "at").alias("x")
        done = len(self._log())
        return self.store.read(CLUSTERS).filter(F.col("at") <= done).groupBy("id").agg(last).select("id", "x.seq", "x.meter", F.col("x.rep.id").alias("rep"))

    # ---- one batch ----

    def accept(self, records: DataFrame, name: str) -> DataFrame:
        """Checks one batch against everything accepted before, adds it, and returns its links (a, b): b is of the batch.

        `records` is a cheap frame of `rides` rows (it is read a few times), numbered by file from 1. Of
        history only records near the batch's times are probed, fields are fetched of candidates alone, and only
        clusters that a new link touches are written. Each table gets one folder per batch, and the entry in the
        table of batches, written last, makes them count.
        """
        log = self._log()
        for r in log:
            if r.name == name:
                return self.store.read_batch(LINKS, f"{r.number:06d}").select("a", "b")
        number, last, bare_old = (log[-1].number + 1, log[-1].last_seq, log[-1].bare) if log else (1, 0, 0)
        key, s = f"{number:06d}", Scratch(self.spark, f"linkage-{number}")
        records = records.withColumn("seq", (F.col("seq") + last).cast("int"))
        days = records.groupBy(F.floor(F.col("p") / 86400).alias("day")).agg(  # one row a day
            F.min("p").alias("lo"), F.max("p").alias("hi"), F.count("*").alias("n"), F.count_if(F.col("meter").isNull()).alias("bare"), F.max("seq").alias("seq")).collect()
        n, bare, top = sum(r.n for r in days), sum(r.bare for r in days), max((r.seq for r in days if r.seq), default=last)
        near = F.lit(False)
        for lo, hi in ranges([(r.lo, r.hi) for r in days if r.day is not None]):
            near = near | F.col("p").between(lo, hi)
        if any(r.day is None for r in days):
            near = near | F.col("p").isNull()
        new, copies = self._collapse(records, s)
        self.store.append(RECORDS, new.withColumn("at", F.lit(number)).sortWithinPartitions("p"), key)
        new = self.store.read_batch(RECORDS, key)
        old = self._history(RECORDS, number, near)
        every = new if old is None else old.unionByName(new)
        pairs = s.write(self._candidates(new, old, every, bare, bare_old), "pairs")
        compared = s.write(self._compare(pairs, every), "compared")
        patterns = self._patterns(compared, chance_pairs(new, n), json.loads(log[-1].patterns) if log else [])
        weights = fit([(dict(zip(LEVELS, x[: len(LEVELS)])), x[-2], x[-1]) for x in patterns])
        self._cluster(compared, copies, weights, number, near, s)
        row = (number, name, int(top), int(bare_old + bare), weights.text(), json.dumps(patterns))
        self.store.append(BATCHES, self.spark.createDataFrame([row], _BATCH), key)
        s.drop()
        return self.store.read_batch(LINKS, key).select("a", "b")

    def _collapse(self, records: DataFrame, s: Scratch) -> tuple[DataFrame, DataFrame]:
        """(one record per group of exact copies of a file, (a, b) of the other copies). Digests alone are shuffled; partial
        aggregation takes the copies first."""
        same = ["seq", "d1", "d2"]
        groups = s.write(records.groupBy(*same).agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n"), "groups")
        if groups.isEmpty():
            return records, records.limit(0).select(F.col("id").alias("a"), "id", "seq", "meter", "p")
        groups = bounded_broadcast(groups, FETCH_ROWS)
        held = records.join(groups, same)
        first = held.filter("id = a").dropDuplicates(["id"]).select(*records.columns)
        return records.join(groups, same, "left_anti").unionByName(first), held.filter("id <> a").select("a", "id", "seq", "meter", "p").distinct()

    def _candidates(self, new: DataFrame, old: DataFrame | None, every: DataFrame, bare: int, bare_old: int) -> DataFrame:
        """(a, b), a of an earlier file than b, b of the batch: records that share a key, each pair once.

        Metered records meet in one equi-join on the key; keys hold the time, so none is hot. Records without a meter
        are few: the new ones probe all records, and the new records probe the old ones among them; their keys are sent
        to the others where the counts of them, kept per batch, are within the broadcast bound, and shuffled beyond it.
        """
        few = lambda df, count: F.broadcast(df) if count * 5 <= FETCH_ROWS else df  # five keys a record at most
        probe = lambda df, keys, i, q: df.select(F.col("id").alias(i), F.col("seq").alias(q), F.explode(keys).alias("key"))
        ordered = [F.when(F.col("xs") < F.col("ys"), F.col(i)).otherwise(F.col(j)).alias(k) for i, j, k in (("x", "y", "a"), ("y", "x", "b"))]
        met = probe(new, metered_keys(), "y", "ys").join(probe(every, metered_keys(), "x", "xs"), "key").filter("xs < ys").select(*ordered)
        lost = probe(new.filter("meter IS NULL"), unmetered_keys(), "y", "ys")
        met = met.unionByName(probe(every, unmetered_keys(), "x", "xs").join(few(lost, bare), "key").filter("xs <> ys").select(*ordered))
        if old is not None and bare_old:
            lost = probe(old.filter("meter IS NULL"), unmetered_keys(), "x", "xs")
            met = met.unionByName(probe(new, unmetered_keys(), "y", "ys").join(few(lost, bare_old), "key").filter("xs < ys").select(*ordered))
        return met.distinct()

    def _compare(self, pairs: DataFrame, every: DataFrame) -> DataFrame:
        """Pairs with the levels of agreement of their fields. Only records that are in a pair leave their file splits."""
        n = pairs.count()  # of a written table
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        r = every.join(F.broadcast(ids) if 2 * n <= FETCH_ROWS else ids, "id", "left_semi")
        side = lambda k, s: r.select(F.col("id").alias(k), F.struct("seq", "d1", "d2", *FIELDS).alias(s))
        full = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
        copy = (F.col("x.d1") == F.col("y.d1")) & (F.col("x.d2") == F.col("y.d2"))
        node = lambda x: F.struct(f"{x}.seq", f"{x}.meter", f"{x}.p")
        return full.select("a", "b", *[c.alias(f) for f, c in comparison().items()], label().alias("label"), copy.alias("copy"), node("x").alias("x"), node("y").alias("y"))

    @staticmethod
    def _patterns(compared: DataFrame, chance: DataFrame, before: list[list]) -> list[list]:
        """Counts of (levels..., label) over all batches so far: one row per pattern, never per pair."""
        levels = comparison()
        a = compared.select(*levels, "label").groupBy(*levels, "label").count()
        b = chance.select(*[c.alias(f) for f, c in levels.items()]).groupBy(*levels).count().withColumn("label", F.lit(0))
        total = {tuple(x[:-1]): x[-1] for x in before}
        for r in a.unionByName(b).collect():
            k = (*[r[f] for f in levels], r.label)
            total[k] = total.get(k, 0) + r["count"]
        return [[*k, n] for k, n in sorted(total.items(), key=repr)]

    def _cluster(self, compared: DataFrame, copies: DataFrame, weights: Weights, number: int, near: Column, s: Scratch) -> None:
        """Stores the links that the weights accept, and the new representatives of the clusters they touch."""
        key = f"{number:06d}"
        # known different meters and starts too far apart never link
        good = F.col("copy") | ((F.col("meter") != 2) & (F.col("time") != 6) & (weights.log_odds() >= math.log(THRESHOLD / (1 - THRESHOLD))))
        linked = s.write(compared.filter(good).select("a", "b", "x", "y"), "linked")
        self.store.append(LINKS, linked.select("a", "b", F.lit(number).alias("at")), key)
        edges = linked.select(F.struct("x.seq", F.col("a").alias("id")).alias("u"), "x", F.struct("y.seq", F.col("b").alias("id")).alias("v"), "y")
        own = F.struct("seq", "meter", "p")
        edges = edges.unionByName(copies.select(F.struct("seq", F.col("a").alias("id")).alias("u"), own.alias("x"), F.struct("seq", "id").alias("v"), own.alias("y")))
        log = self._history(CLUSTERS, number, near)
        if log is not None:  # records of history stand for their clusters
            rep = log.groupBy("id").agg(F.max_by("rep", "at").alias("rep")).withColumnRenamed("id", "_id")
            edges = edges.join(rep, F.col("u.id") == F.col("_id"), "left").drop("_id")
        else:
            edges = edges.withColumn("rep", F.lit(None).cast("struct<seq:int,id:bigint>"))
        edges = s.write(edges, "edges")
        found = union_find(edges.select(F.coalesce("rep", "u").alias("a"), F.col("v").alias("b")), s)
        nodes = edges.select(F.col("v").alias("node"), F.col("y").alias("x")).unionByName(edges.filter("rep IS NULL").select(F.col("u").alias("node"), "x")).distinct()
        rows = nodes.join(found, F.col("node") == F.col("id")).select("node.id", "x.*", "rep")
        merged = found.filter("id <> rep").join(edges.filter("rep IS NOT NULL").select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
        if log is not None and not merged.isEmpty():  # a link joined clusters of history: all their members change
            log = self.store.read(CLUSTERS).filter(F.col("at") < number)
            latest = log.groupBy("id").agg(F.max_by(F.struct("seq", "meter", "p", "rep"), "at").alias("x")).select("id", "x.*").withColumnRenamed("rep", "was")
            rows = rows.unionByName(latest.join(merged.select(F.col("id").alias("was"), "rep"), "was").select("id", "seq", "meter", "p", "rep"))
        self.store.append(CLUSTERS, rows.withColumn("at", F.lit(number)), key)

    # ---- whole tables ----

    def replay(self, df: DataFrame, files: int = FILES_PER_BATCH) -> "Linker":
        """Takes in a table's files in order of arrival, so many at a time. The compared fields are first put down by file."""
        inbox = self.scratch.write(rides(df), "inbox", ["seq"])
        last = inbox.agg(F.max("seq")).first()[0] or 0
        for at in range(0, last, files):
            batch = inbox.filter(F.col("seq").between(at + 1, min(at + files, last)))
            self.accept(batch.withColumn("seq", F.col("seq") - at), f"files-{at + 1}")
        return self

    def pairs(self) -> DataFrame:
        """(a, b), a < b: all pairs of a cluster that come from different files and do not name different meters.

        Files of a cluster are paired first, then their records: records of one file never meet, so the
        work is the size of the result however many copies one file holds.
        """
        members = self.scratch.write(self.clusters(), f"members-{uuid.uuid4().hex}")
        held = members.select("rep", "seq").distinct()
        files = held.select("rep", F.col("seq").alias("s1")).join(held.select("rep", F.col("seq").alias("s2")), "rep").filter("s1 < s2")
        x = members.select("rep", F.col("seq").alias("s1"), F.col("id").alias("i"), F.col("meter").alias("m1"))
        y = members.select("rep", F.col("seq").alias("s2"), F.col("id").alias("j"), F.col("meter").alias("m2"))
        met = files.join(x, ["rep", "s1"]).join(y, ["rep", "s2"]).filter("coalesce(m1 = m2, true)")
        return met.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
