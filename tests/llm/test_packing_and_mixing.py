import random
from collections import defaultdict

import numpy as np
from conftest import rows

from millrace.llm import mixing, packing
from millrace.llm.tokens import encoder, token_count, tokenizer_path

DOCS = "doc_id bigint, text string, source string, tokens string, shard string"


def docs(n=120, seed=1):
    rng = random.Random(seed)
    out = [(i, " ".join(rng.choice(["flow", "map", "kernel", "x_1", "42"]) for _ in range(rng.randrange(0, 90))), rng.choice(["a", "A ", " a", "b", "b", None, "c"]), "own", "own") for i in range(n)]
    return out + [(None, "no id here", "a", "o", "o"), (900, None, "a", "o", "o"), (901, "", "b", "o", "o"), (902, "word " * 3000, "b", "o", "o")]


def sizes(data):
    enc = encoder(tokenizer_path())
    return {r[0]: len(enc.encode_ordinary(r[1])) if r[1] else 0 for r in data}


def test_token_counts(frame):
    d = [*docs(20), (7777, "<|endoftext|> is text", "a", "", "")]
    assert dict(rows(frame(d, DOCS).select("doc_id", token_count("text").alias("n")))) == sizes(d)


def test_every_piece_is_packed_once_and_fits(frame):
    d = docs()
    caps = frame([(1, 64), (2, 500), (3, None), (4, 0)], "capacity_id int, capacity_tokens int")
    want, got = sizes(d), rows(packing.pack(frame(d, DOCS), caps), "capacity_id", "container_id", "doc_id", "piece", "tokens")
    assert {r[0] for r in got} == {1, 2}
    for cap_id, cap in ((1, 64), (2, 500)):
        per, boxes = defaultdict(list), defaultdict(int)
        for c, box, doc, piece, n in got:
            if c == cap_id:
                per[doc].append((piece, n))
                if box >= 0:
                    boxes[box] += n
                assert (box == -1) == (n == 0)
        assert {k: sum(n for _, n in v) for k, v in per.items()} == want
        assert max(boxes.values()) <= cap
        for doc, v in per.items():
            v.sort()
            assert [p for p, _ in v] == list(range(len(v)))
            assert len(v) == 1 if want[doc] <= cap else all(n == cap for _, n in v[:-1])
        lower = -(-sum(want.values()) // cap)
        assert len(boxes) <= lower * 1.1 + 2


def test_sum_of_squares_matches_a_plain_version():
    rng = random.Random(3)
    for cap in (10, 37):
        items = np.array([rng.randrange(1, cap + 1) for _ in range(200)])
        got = packing.sum_of_squares(items, cap)
        # a plain version: try every gap, measure the whole sum of squares
        counts, used, gaps = defaultdict(int), 0, []
        for s in sorted(items, reverse=True):
            best = None
            for g in [*sorted(k for k, c in counts.items() if c and k >= s), cap + 1]:
                c = dict(counts)
                rest = (cap if g == cap + 1 else g) - s
                if g <= cap:
                    c[g] -= 1
                if rest:
                    c[rest] = c.get(rest, 0) + 1
                score = sum(v * v for v in c.values())
                if best is None or score < best[0]:
                    best = (score, g, c)
            used += best[1] == cap + 1
            counts = defaultdict(int, best[2])
            gaps.append(best[1])
        load = np.bincount(got, items)
        assert load.max() <= cap and len(load) == used


def test_shards_of_hot_sizes(frame, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 50)
    d = [(i, "same words here", "a", "", "") for i in range(400)] + [(5, "same words here", "a", "", "")]
    got = packing.pack(frame(d, DOCS), frame([(1, 20)], "capacity_id int, capacity_tokens int"))
    assert got.count() == 401 and got.select("container_id").distinct().count() >= 401 * 3 // 20
    fill = packing.fill(got, frame([(1, 20)], "capacity_id int, capacity_tokens int")).first()
    assert fill.tokens == 401 * 3 and 0 <= fill.unused_share < 0.4


def test_packing_nothing(frame):
    caps = frame([(1, 64)], "capacity_id int, capacity_tokens int")
    assert packing.pack(frame([], DOCS), caps).count() == 0
    assert packing.pack(frame(docs(3), DOCS), caps.limit(0)).count() == 0


TARGETS = "source string, target_share double, max_repeats int"


def test_shares_are_met_and_caps_hold(frame):
    rng = random.Random(8)
    d = [(i, "word " * rng.randrange(1, 60), s, "", "") for i, s in enumerate(["a"] * 3000 + ["B "] * 600 + ["c"] * 40 + ["none"] * 100)]
    m = mixing.Mixer(frame(d, DOCS), frame([("a", 0.5, 1), ("b", 0.3, 3), ("C", 0.1, 5), ("ghost", 0.1, 2)], TARGETS))
    got = m.sample()
    drawn = got.collect()
    assert len({r.doc_id for r in drawn}) == len(drawn)
    caps, want = {"a": 1, "b": 3, "c": 5}, sizes(d)
    assert all(r.copies <= caps[r.source] and r.tokens == want[r.doc_id] for r in drawn)
    shares = {r.source: r for r in m.shares(got).collect()}
    for s, target in (("a", 0.5 / 0.9), ("b", 0.3 / 0.9), ("c", 0.1 / 0.9)):
        assert abs(shares[s].actual_share - target) < 0.005
    assert shares["ghost"].tokens == 0 and shares["ghost"].actual_share == 0.0
    again = mixing.Mixer(frame(d, DOCS).repartition(7), frame([("a", 0.5, 1), ("b", 0.3, 3), ("C", 0.1, 5), ("ghost", 0.1, 2)], TARGETS)).sample()
    assert rows(again) == rows(got)


def test_rate_solves_the_total():
    cells = [(10, 5.0, 25.0), (3, 50.0, 2500.0)]
    for need in (10.0, 150.0, 380.0):
        c = mixing.rate(cells, 2, need)
        assert abs(sum(n * (t * 2 if c * t >= 2 else c * q) for n, t, q in cells) - need) < 1e-6
    assert mixing.rate(cells, 2, 400.0) == float("inf") and mixing.rate([], 2, 5.0) == 0.0


def test_mixing_edges(frame):
    assert mixing.Mixer(frame([], DOCS), frame([("a", 1.0, 1)], TARGETS)).sample().count() == 0
    assert mixing.Mixer(frame(docs(5), DOCS), frame([], TARGETS)).sample().count() == 0
    m = mixing.Mixer(frame([(1, None, "a", "", ""), (2, "", "a", "", ""), (3, "x", None, "", "")], DOCS), frame([("a", 1.0, 1), (None, 0.5, 1)], TARGETS))
    got = m.sample()
    assert got.count() == 0 and rows(m.shares(got), "source", "actual_share") == [("a", 0.0)]
    same = mixing.Mixer(frame([(1, "t t t", "a", "", "")] * 4, DOCS), frame([("a", 1.0, 2)], TARGETS)).sample()
    assert rows(same, "doc_id", "copies") == [(1, 2)] * 4


def test_one_repeated_item_is_spread_over_shards(spark, frame, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 7)
    items = spark.range(100).selectExpr("CAST(5 AS BIGINT) doc_id", "CAST(3 AS BIGINT) tokens").unionByName(spark.range(3).selectExpr("id doc_id", "CAST(NULL AS BIGINT) tokens"))
    got = rows(packing.numbered(items))
    assert got == sorted([(5, 3, i) for i in range(100)] + [(i, None, 0) for i in range(3)], key=repr)
    shards = packing.numbered(items.filter("doc_id = 5")).selectExpr("pmod(xxhash64(doc_id, tokens, copy), 4) s").groupBy("s").count().collect()
    assert len(shards) == 4 and all(10 < r["count"] < 45 for r in shards)
