"""Packing token streams into blocks and segments into records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import END, START
from .segments import chance


def pack_blocks(docs: DataFrame, shard: str, order: str, tokens: str, length: int) -> DataFrame:
    """(shard, block_no, block): documents as START + tokens + END, one after the other,
    cut into blocks of the given length. After each document a rest of at most
    length / 8 is discarded, a longer one carried on; a shard's last rest is dropped.

    A shard is a stream by definition (each place depends on what came before); it passes
    one worker sorted, and only the rest and one document are held. Shards give the
    parallelism: take many. Null tokens count as an empty document.
    """
    kind = docs.schema[shard].dataType.simpleString()
    rows = docs.select(shard, order, F.coalesce(F.col(tokens).cast("array<int>"), F.array().cast("array<int>")).alias("_t")).repartition(shard).sortWithinPartitions(shard, order)
    names = [shard, "block_no", "block"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rest, made, first = None, [], 0, True
        for pdf in batches:
            out = []
            for k, t in zip(pdf[shard], pdf["_t"]):
                if first or k != now:
                    now, rest, made, first = k, [], 0, False
                rest = rest + [START, *t, END]
                whole = len(rest) // length
                for i in range(whole):
                    out.append((k, made, rest[i * length : (i + 1) * length]))
                    made += 1
                rest = rest[whole * length :]
                if len(rest) <= length // 8:
                    rest = []
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, f"`{shard}` {kind}, block_no int, block array<int>")


def block_counts(docs: DataFrame, shard: str, order: str, n_tokens: str, length: int) -> DataFrame:
    """(shard, blocks, discarded, carried): what pack_blocks makes, from lengths alone, by a
    fold over a shard's lengths in order. For shards of moderate numbers of documents."""
    step = F.col(n_tokens).cast("bigint") + 2
    rows = docs.groupBy(shard).agg(F.array_sort(F.collect_list(F.struct(F.col(order), step.alias("n")))).alias("l"))
    zero = F.struct(F.lit(0).cast("bigint").alias("blocks"), F.lit(0).cast("bigint").alias("discarded"), F.lit(0).cast("bigint").alias("carried"))

    def fold(acc, x):
        total = acc["carried"] + x["n"]
        rest = total % length
        small = rest <= length // 8
        return F.struct((acc["blocks"] + F.floor(total / length)).cast("bigint").alias("blocks"), (acc["discarded"] + F.when(small, rest).otherwise(0)).cast("bigint").alias("discarded"), F.when(small, F.lit(0)).otherwise(rest).cast("bigint").alias("carried"))

    return rows.select(shard, F.aggregate("l", zero, fold).alias("r")).select(shard, "r.blocks", "r.discarded", "r.carried")


def grouped_rows(df: DataFrame, keys: list[str], order: list[str], n: int, values: str) -> DataFrame:
    """Rows of a key, n by n in order, as arrays; the last group may be shorter."""
    w = Window.partitionBy(*keys).orderBy(*order)
    g = df.withColumn("grp", F.floor((F.row_number().over(w) - 1) / n).cast("int")).withColumn("_at", F.row_number().over(w))
    rows = g.groupBy(*keys, "grp").agg(F.array_sort(F.collect_list(F.struct("_at", values))).alias("l"))  # n entries at most
    return rows.select(*keys, "grp", F.transform("l", lambda x: x[values]).alias("items"))


class Packer:
    """Groups of exactly size segments. A video gives full groups as long as it has them; its
    rest waits. When more than `most` rests wait, a group is made of them: the longest, then
    what fits whole from the longer to the shorter, and then parts of single rests.

    With a seed, parts come from a rest's front with the chance `front`, else from its back, and
    the rest to be cut is drawn by hash; without one, parts come from the front, and of the
    rests the one with the least key is cut.
    """

    def __init__(self, size: int, most: int, seed: int | None = None, front: float = 0.8, shard: object = ""):
        self.size, self.most, self.seed, self.front, self.shard = size, most, seed, front, shard
        self.left: dict = {}
        self.drawn = 0

    def _chance(self) -> float:
        self.drawn += 1
        return chance(self.seed, self.shard, self.drawn)

    def _part(self, first: int, n: int, take: int) -> tuple[int, tuple[int, int]]:
        """Where a part of a rest begins, and what is left of the rest."""
        if self.seed is None or self._chance() < self.front:
            return first, (first + take, n - take)
        return first + n - take, (first, n - take)

    def add(self, key, first: int, n: int) -> Iterator[list[tuple]]:
        while n >= self.size:
            at, (first, n) = self._part(first, n, self.size)
            yield [(key, at, self.size)]
        if n:
            self.left[key] = (first, n)
        while len(self.left) > self.most:
            g = self._join()
            if g:
                yield g

    def finish(self) -> Iterator[list[tuple]]:
        while self.left:
            g = self._join()
            if g:
                yield g

    def _join(self) -> list[tuple] | None:
        """One group of the rests; None if all of them together make none."""
        group, room = [], self.size
        for key, (first, n) in sorted(self.left.items(), key=lambda x: (-x[1][1], x[0])):
            if n <= room:
                group.append((key, first, n))
                room -= n
                del self.left[key]
        while room and self.left:
            keys = sorted(self.left)
            key = keys[0] if self.seed is None else keys[int(self._chance() * len(keys))]
            first, n = self.left.pop(key)
            take = min(n, room)
            at, rest = self._part(first, n, take)
            group.append((key, at, take))
            room -= take
            if rest[1]:
                self.left[key] = rest
        return group if not room else None


def pack_groups(counts: DataFrame, shard: str, key: str, n: str, size: int = 16, most: int = 160, seed: int | None = None) -> DataFrame:
    """(shard, group_no, part_no, key, first, n): which segments of which videos make each
    group. Only counts pass the worker; the waiting videos are at most `most`. A shard's
    last incomplete group is dropped."""
    ks, kk = (counts.schema[c].dataType.simpleString() for c in (shard, key))
    rows = counts.where(f"{n} > 0").select(shard, key, F.col(n).cast("int").alias("_n")).repartition(shard).sortWithinPartitions(shard, key)
    names = [shard, "group_no", "part_no", key, "first", "n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, p, made = None, None, 0

        def rows_of(groups, k) -> Iterator[tuple]:
            nonlocal made
            for g in groups:
                yield from ((k, made, i, *part) for i, part in enumerate(g))
                made += 1

        for pdf in batches:
            out = []
            for s, k, c in zip(pdf[shard], pdf[key], pdf["_n"]):
                if p is None or s != now:
                    if p is not None:
                        out += rows_of(p.finish(), now)
                    now, p, made = s, Packer(size, most, seed, shard=s), 0
                out += rows_of(p.add(k, 0, int(c)), s)
            yield pd.DataFrame(out, columns=names)
        if p is not None:
            yield pd.DataFrame(list(rows_of(p.finish(), now)), columns=names)

    return rows.mapInPandas(run, f"`{shard}` {ks}, group_no int, part_no int, `{key}` {kk}, first int, n int")
