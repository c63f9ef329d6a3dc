"""Filling containers of fixed capacity: sum-of-squares packing.

Each item goes where the sum of squares of the numbers of open containers per residual gap becomes
smallest (a new container is one of the choices). Sizes, not texts, are shuffled; items are spread
over shards of about SHARD_ITEMS by a digest of their id and number among rows that repeat it, and every
shard is packed by itself, so the work is linear, one item that holds a third of all rows is spread like any
other, and only a shard's last open containers can be poorly filled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokens import sized
from millrace.session import Scratch, bounded_broadcast, ship, text_batches

#: Items a shard holds on average; a shard is packed in one task.
SHARD_ITEMS = 20_000
#: Repeated rows are counted first and spread in blocks of so many.
BLOCK = 10_000
#: Items are packed once per capacity; more capacities are refused.
MOST_CAPACITIES = 1000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, sizes 1 .. capacity, packed largest first; ties take the smallest gap."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open containers per gap; a gap of 0 is closed
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), dtype=np.int64)
    used = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        gaps = np.flatnonzero(count[s:]) + s
        best, at = (2 * count[capacity - s] + 1 if s < capacity else 0), 0
        if len(gaps):
            change = 1 - 2 * count[gaps]
            rest = gaps - s
            change = change + np.where(rest > 0, 2 * count[rest] + 1, 0)
            k = int(change.argmin())
            if change[k] <= best:
                at = int(gaps[k])
        if at:
            box = stacks[at].pop()
            count[at] -= 1
        else:
            box, at, used = used, capacity, used + 1
        out[i] = box
        if at > s:
            stacks[at - s].append(box)
            count[at - s] += 1
    return out


def split_sizes(ids: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the item, piece number, piece size): an item over the capacity becomes full pieces and a rest; empty items one piece of 0."""
    pieces = np.maximum(1, -(-sizes // capacity))
    at = np.repeat(np.arange(len(ids)), pieces)
    no = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return at, no, np.where(no < pieces[at] - 1, capacity, sizes[at] - no * capacity)


def numbered(items: DataFrame) -> DataFrame:
    """(doc_id, tokens, copy): rows that repeat one id and size are numbered without being brought together: they are
    counted with map-side combine, and the count is unfolded in blocks."""
    counted = items.groupBy("doc_id", "tokens").agg(F.count("*").alias("n"))
    blocks = counted.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {BLOCK}"))))
    first = F.col("_b") * BLOCK
    return blocks.withColumn("copy", F.explode(F.sequence(first, F.least(first + BLOCK, F.col("n")) - 1))).select("doc_id", "tokens", "copy")


def pack(documents: DataFrame, capacities: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(capacity_id, container_id, doc_id, piece, tokens), one row per piece.

    A text is split only if it alone exceeds the capacity: into full containers and a rest that is
    packed like any other. Empty and null texts take no room and are listed in container -1.
    Repeated rows are packed as often as they occur; null ids are items too. Capacities that are
    null or below 1 are left out; an empty table gives no rows.
    """
    spark = documents.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "packing")
    with text_batches(spark):
        items = scratch.write(sized(documents), "sizes")
    shards = max(1, -(-items.count() // SHARD_ITEMS))
    caps = [(r.capacity_id, r.capacity_tokens) for r in capacities.filter("capacity_tokens >= 1").limit(MOST_CAPACITIES + 1).collect()]
    if len(caps) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    schema = "capacity_id int, container_id bigint, doc_id bigint, piece int, tokens bigint"
    if not caps:
        return spark.createDataFrame([], schema)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("capacity_id"), F.lit(c).alias("capacity")) for i, c in caps]))
    spread = numbered(items).withColumn("shard", F.pmod(F.xxhash64("doc_id", "tokens", "copy"), F.lit(shards))).withColumn("_c", each).select("doc_id", "tokens", "shard", "_c.*")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        capacity, shard = int(rows["capacity"].iloc[0]), int(rows["shard"].iloc[0])
        rows = rows.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable")
        at, no, size = split_sizes(rows["doc_id"].to_numpy(), rows["tokens"].to_numpy(), capacity)
        box = np.full(len(at), -1, dtype=np.int64)
        full = size > 0
        box[full] = shard * (1 << 32) + sum_of_squares(size[full], capacity)
        return pd.DataFrame({"capacity_id": rows["capacity_id"].iloc[0], "container_id": box, "doc_id": rows["doc_id"].to_numpy()[at], "piece": no.astype("int32"), "tokens": size})

    return spread.groupBy("shard", "capacity_id").applyInPandas(one, schema)


def fill(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity_id, containers, tokens, unused_share) of each capacity."""
    used = packed.filter("container_id >= 0").groupBy("capacity_id", "container_id").agg(F.sum("tokens").alias("t"))
    per = used.groupBy("capacity_id").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    return per.join(bounded_broadcast(capacities), "capacity_id").select(
        "capacity_id", "containers", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("unused_share"))
