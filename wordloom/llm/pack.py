"""Filling fixed-capacity containers: vector bin packing by the dot-product heuristic.

An item is a vector (tokens, segments, loss-bearing tokens), a container a vector of
limits. A container is filled by taking, again and again, the fitting item with the
greatest weighted dot product of item and room left. Items of equal vectors are alike,
so a shard is packed by classes of vectors, and a filling pattern is applied as often as
its classes last, which gives exactly what the item-by-item heuristic gives.

Items go to shards by a hash of their key, so a shard's size is bounded whatever the
keys are like; only lengths are shuffled, never tokens. Each shard leaves at most a few
containers partly filled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items of a shard, on the average.
SHARD_ITEMS = 32_768
#: The segments one container may hold.
MAX_SEGMENTS = 16
#: The loss-bearing tokens one container may hold, as a share of its capacity. At 1 this limit
#: is no narrower than the tokens' own.
LOSS_SHARE = 1.0
#: Ids up to this one are control tokens, which bear no loss.
LAST_CONTROL = 9

PLACED = "stream_name string, shard int, container_no int, record_id bigint, seg_idx int, part int, n_parts int, n_tokens int, n_loss int"


def fill(sizes: np.ndarray, counts: np.ndarray, limits: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Patterns (classes, how many of each, how many containers) that place all items.

    sizes: one row a class; every row must fit into limits. The weights of the dimensions
    are their total demands against the limits.
    """
    left, unit = counts.astype(np.int64).copy(), sizes / limits
    demand = (unit * left[:, None]).sum(axis=0)
    weight = demand / max(demand.max(), 1e-12)
    out = []
    while left.any():
        room, need, open_ = limits.astype(np.int64).copy(), {}, left.copy()
        while True:
            fits = (open_ > 0) & (sizes <= room).all(axis=1)
            if not fits.any():
                break
            at = np.flatnonzero(fits)
            best = int(at[np.argmax(unit[at] @ (weight * room / limits))])
            need[best] = need.get(best, 0) + 1
            open_[best] -= 1
            room -= sizes[best]
        cls, many = np.fromiter(need.keys(), np.int64), np.fromiter(need.values(), np.int64)
        times = int((left[cls] // many).min())
        left[cls] -= many * times
        out.append((cls, many, times))
    return out


def pack_shard(pdf: pd.DataFrame, max_segments: int, loss_share: float = LOSS_SHARE) -> pd.DataFrame:
    """One shard of one stream: its items with their container numbers. An item that bears
    more loss than a container may is taken as one that fills this limit by itself."""
    pdf = pdf.sort_values(["record_id", "seg_idx", "part"], na_position="first", kind="stable").reset_index(drop=True)
    cap = int(pdf["capacity"].iloc[0])
    vec = pdf[["n_tokens", "n_loss"]].to_numpy(np.int64)
    sizes, cls, counts = np.unique(vec, axis=0, return_inverse=True, return_counts=True)
    full = np.column_stack([sizes[:, 0], np.ones(len(sizes), np.int64), sizes[:, 1]])
    order = np.argsort(cls.ravel(), kind="stable")
    at = np.concatenate([[0], np.cumsum(counts)[:-1]])
    box, used = np.empty(len(pdf), np.int64), 0
    most_loss = max(1, int(cap * loss_share))
    full[:, 2] = np.minimum(full[:, 2], most_loss)
    for which, many, times in fill(full, counts, np.array([cap, max_segments, most_loss])):
        for c, k in zip(which, many):
            box[order[at[c] : at[c] + k * times]] = used + np.repeat(np.arange(times), k)
            at[c] += k * times
        used += times
    return pdf.assign(container_no=box)[[x.split()[0] for x in PLACED.split(", ")]]


def length_without_padding(tokens: Column) -> Column:
    """The size of an array without the padding (0 or null) at its end; 0 for null."""
    last = F.element_at(tokens, -1)
    scan = F.coalesce(F.array_max(F.transform(tokens, lambda x, i: F.when(x != 0, i + 1))), F.lit(0))
    return F.when(tokens.isNull() | (F.size(tokens) == 0), 0).when(last != 0, F.size(tokens)).otherwise(scan)


def items(segments: DataFrame, budget: DataFrame) -> DataFrame:
    """(record_id, seg_idx, _lone, stream_name, capacity, part, n_parts, n_tokens, n_loss).

    A row of segments is one item of each stream that has tokens besides padding; rows
    delivered again (equal record_id and seg_idx) count once, of different arrays the
    longest of each stream for itself. Rows with a null in record_id or seg_idx name no
    segment and are items of their own, each with its number in _lone (else null). An item longer than the
    capacity is cut into full parts and a rest. Streams without a positive capacity in
    budget are not packed; of several, the greatest counts.
    """
    streams = ("tok_ids", "random_text")
    # At most one row a stream of the two: small whatever the input.
    caps = {r[0]: r[1] for r in budget.where(F.col("stream_name").isin(*streams)).groupBy("stream_name").agg(F.max("capacity")).collect()}

    def parts(name: str, cap: int) -> Column:
        n = length_without_padding(F.col(name))
        cut = lambda p: F.slice(F.slice(F.col(name), 1, n), p * cap + 1, F.lit(cap))
        one = lambda p: F.struct(p.cast("int").alias("part"), F.size(cut(p)).alias("n_tokens"), F.size(F.filter(cut(p), lambda x: x > LAST_CONTROL)).alias("n_loss"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.ceil(n / cap).cast("int") - 1), one))

    known = {s: c for s, c in caps.items() if c and c > 0}
    if not known:
        known = {"tok_ids": 1}
        segments = segments.limit(0)
    rows = segments.select("record_id", "seg_idx", *[parts(s, c).alias(f"_{s}") for s, c in known.items()])
    # Rows without a whole key are told apart by a number of their own.
    lone = F.when(F.col("record_id").isNull() | F.col("seg_idx").isNull(), F.monotonically_increasing_id())
    # Parts are compared by how many tokens they hold in all before anything else.
    longest = lambda s: F.max(F.when(F.col(f"_{s}").isNotNull(), F.struct(F.size(f"_{s}"), F.element_at(f"_{s}", -1)["n_tokens"], F.col(f"_{s}").alias("parts"))))["parts"]
    rows = rows.groupBy("record_id", "seg_idx", lone.alias("_lone")).agg(*[longest(s).alias(f"_{s}") for s in known])
    each = [F.struct(F.lit(s).alias("stream_name"), F.lit(int(c)).alias("capacity"), F.col(f"_{s}").alias("parts")) for s, c in known.items()]
    rows = rows.select("record_id", "seg_idx", "_lone", F.explode(F.array(*each)).alias("y")).where("y.parts is not null")
    rows = rows.select("record_id", "seg_idx", "_lone", "y.stream_name", "y.capacity", F.size("y.parts").alias("n_parts"), F.explode("y.parts").alias("p"))
    return rows.select("record_id", "seg_idx", "_lone", "stream_name", "capacity", "n_parts", "p.part", "p.n_tokens", "p.n_loss")


def pack_segments(segments: DataFrame, budget: DataFrame, max_segments: int = MAX_SEGMENTS, shard_items: int = SHARD_ITEMS, loss_share: float = LOSS_SHARE) -> DataFrame:
    """Every item's container: stream_name, shard and container_no name a container.
    Each stream is packed for itself, each item (each part of a cut one) placed once."""
    shards = max(1, math.ceil(segments.count() / shard_items))
    rows = items(segments, budget).withColumn("shard", F.pmod(F.xxhash64("record_id", "seg_idx", "_lone"), F.lit(shards)).cast("int"))
    return rows.groupBy("stream_name", "shard").applyInPandas(lambda pdf: pack_shard(pdf, max_segments, loss_share), PLACED)
