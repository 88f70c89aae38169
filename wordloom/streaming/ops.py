"""Operators on streams: counts by window, copies, and packing with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import END, START


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts by key and window; rows later than the watermark are left out."""
    w = F.window(time, width)
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def without_copies(rows: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """The first of the rows with equal keys; state is kept as long as the watermark asks."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """Runs of a key's events with less than the gap between them."""
    w = F.session_window(time, gap)
    out = events.withWatermark(time, late).groupBy(w, key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def packed_blocks(docs: DataFrame, shard: str, order: str, tokens: str, length: int) -> DataFrame:
    """(shard, block_no, block): the packing of text blocks with the rest kept as state, so
    that a stream of documents gives the blocks that one batch of them would, in the order
    of arrival (within a micro-batch by the order column)."""
    kind = docs.schema[shard].dataType.simpleString()

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # State holds no arrays: the rest is kept as text.
        rest, made = ([int(x) for x in state.get[0].split()], state.get[1]) if state.exists else ([], 0)
        out = []
        pdf = pd.concat(list(parts)).sort_values(order)
        for t in pdf[tokens]:
            rest += [START, *([] if t is None else (int(x) for x in t)), END]
            while len(rest) >= length:
                out.append((key[0], made, rest[:length]))
                rest, made = rest[length:], made + 1
            if len(rest) <= length // 8:
                rest = []
        state.update((" ".join(map(str, rest)), made))
        yield pd.DataFrame(out, columns=[shard, "block_no", "block"])

    rows = docs.select(shard, order, F.col(tokens).cast("array<int>").alias(tokens))
    return rows.groupBy(shard).applyInPandasWithState(run, f"`{shard}` {kind}, block_no int, block array<int>", "rest string, made int", "append", "NoTimeout")
