"""Splits that keep related records together: grouped iterative stratification.

Videos that share a channel in any crawl, and channels that share a video, are one
component. Components carry their number of rows and a vector of rows by label, and
those with the rarest outstanding label go first, each to the split that needs that
label most; then single components are moved where that brings rows and labels nearer to
the wanted shares. Components of at least 1/1000 of all rows (at most 1000 of them) are placed
on the driver; the many light ones are placed shard by shard, each shard with its part
of what the heavy ones left open, so that no task and no driver holds more than a bounded
number of components. Shards are many light components each, so their rounding is small
against 1/1000 of the rows; p3_balance measures what is reached.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .components import components
from .crawl import latest_crawl, stripped

#: A component with more than this part of all rows is placed on the driver.
HEAVY = 1000
#: Light components of a shard, on the average.
SHARD_GROUPS = 20_000
#: Labels counted each for itself, the most frequent ones; all others are one label together.
LABELS = 63
#: Rounds of moves after the placing.
ROUNDS = 4


def channel_links(segments: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(youtube_id, channel) of all crawls of the videos that occur in segments, each
    once, with the video's least channel as first; and the links (a, b) of channels."""
    seen = segments.where("youtube_id is not null and youtube_id <> ''").select("youtube_id").distinct()
    pairs = meta.select("youtube_id", stripped(F.col("channel_id")).alias("channel")).where("channel is not null").distinct()
    pairs = pairs.join(seen, "youtube_id", "left_semi")
    least = pairs.groupBy("youtube_id").agg(F.min("channel").alias("first"))
    links = pairs.join(least, "youtube_id").where("channel <> first").select(F.col("channel").alias("a"), F.col("first").alias("b")).distinct()
    return least, links


def channel_roots(segments: DataFrame, meta: DataFrame) -> DataFrame:
    """(channel, root): the component of every channel of a video in segments, named by its
    least channel; one row a channel, alone or not."""
    first, links = channel_links(segments, meta)
    every = links.select(F.col("a").alias("channel")).unionByName(first.select(F.col("first").alias("channel"))).distinct()
    return every.join(components(links).withColumnRenamed("node", "channel"), "channel", "left").select("channel", F.coalesce("root", "channel").alias("root"))


def joined_channels(segments: DataFrame, meta: DataFrame) -> DataFrame:
    """(channel_a, channel_b), the smaller first: the pairs that must share a split."""
    roots = components(channel_links(segments, meta)[1])
    other = roots.select(F.col("node").alias("channel_b"), "root")
    return roots.select(F.col("node").alias("channel_a"), "root").join(other, "root").where("channel_a < channel_b").select("channel_a", "channel_b")


def place(weights: np.ndarray, need: np.ndarray) -> np.ndarray:
    """The split of each group. weights: one row a group, first its rows, then its rows by
    label; need: one row a split, what it still lacks of each. need is changed. Of the
    splits that have room for a group's rows, the one that needs its label most gets it,
    so that labels never push a split beyond its share of rows; without room anywhere,
    the one that lacks the most rows."""
    split = np.full(len(weights), -1)
    open_ = weights[:, 1:].sum(axis=0)
    order = np.argsort(-weights[:, 0], kind="stable")
    columns = [order[weights[order, 1 + j] > 0] for j in range(weights.shape[1] - 1)]

    def put(g: int, s: int) -> None:
        split[g] = s
        need[s] -= weights[g]
        open_[:] -= weights[g, 1:]

    while (open_ > 0).any():
        label = int(np.flatnonzero(open_ > 0)[np.argmin(open_[open_ > 0])])
        for g in columns[label]:
            if split[g] < 0:
                room = np.flatnonzero(need[:, 0] >= weights[g, 0])
                if len(room):
                    want = need[room, 1 + label]
                    room = room[want >= want.max() - 1e-9]
                    put(g, int(room[np.argmax(need[room, 0])]))
                else:
                    put(g, int(np.argmax(need[:, 0])))
        open_[label] = 0
    for g in order:
        if split[g] < 0:
            put(g, int(np.argmax(need[:, 0])))
    return split


def refine(weights: np.ndarray, split: np.ndarray, target: np.ndarray, under: float = 1.0, rounds: int = ROUNDS) -> np.ndarray:
    """The splits after moves of single groups, largest first, each to the split where the sum
    of squared deviations of rows and labels from target, each against its total, gets
    least. What is lacking counts `under` times as much as what is too much. A round that
    moves nothing is the last one."""
    if not len(weights):
        return split
    scale = 1.0 / np.maximum(target.sum(axis=0), 1.0)
    scale[0] *= 4  # rows first
    unit = np.sqrt(scale)
    w, over = weights * unit, -target * unit
    np.add.at(over, split, w)
    cost = lambda x: (np.where(x > 0, x, under * x) * x).sum(axis=1)
    order = np.argsort(-weights[:, 0], kind="stable")
    for _ in range(rounds):
        moved = False
        for g in order:
            v, s = w[g], split[g]
            over[s] -= v
            change = cost(over + v) - cost(over)
            to = int(np.argmin(change))
            if change[to] > change[s] - 1e-9:
                to = int(s)
            over[to] += v
            moved = moved or to != s
            split[g] = to
        if not moved:
            break
    return split


def assign_splits(segments: DataFrame, meta: DataFrame, plan: DataFrame, shard_groups: int = SHARD_GROUPS) -> DataFrame:
    """(youtube_id, split_name, n_rows) of every video that segments name.

    Labels are the categories of a video's latest crawl. Videos without any channel are
    components of their own. Shares are those of plan, scaled to a sum of 1; splits with
    a null or negative share get nothing. An empty plan is an error.
    """
    wanted = [(r[0], float(r[1])) for r in plan.where("split_name is not null and share_pct > 0").orderBy(F.desc("share_pct"), "split_name").select("split_name", "share_pct").collect()]
    if not wanted:
        raise ValueError("split_plan names no split with a positive share")
    names = [n for n, _ in wanted]
    share = np.array([s for _, s in wanted]) / sum(s for _, s in wanted)
    sizes = segments.where("youtube_id is not null and youtube_id <> ''").groupBy("youtube_id").agg(F.count("*").alias("n"))
    first, links = channel_links(segments, meta)
    roots = components(links)
    video = sizes.join(first, "youtube_id", "left").join(roots.withColumnRenamed("node", "first"), "first", "left")
    video = video.select("youtube_id", "n", F.coalesce(F.concat(F.lit("c:"), F.coalesce("root", "first")), F.concat(F.lit("v:"), "youtube_id")).alias("grp"))
    video = cut(video.join(latest_crawl(meta, "categories").select("youtube_id", "categories"), "youtube_id", "left"))
    rows = video.select("grp", "n", F.explode("categories").alias("label")).where("label is not null")
    known = [r["label"] for r in rows.groupBy("label").agg(F.sum("n").alias("m")).orderBy(F.desc("m"), "label").limit(LABELS).collect()]
    cells = len(known) + 1
    cell = F.coalesce(F.element_at(F.create_map(*[x for i, k in enumerate(known) for x in (F.lit(k), F.lit(i))]), F.col("label")), F.lit(len(known))) if known else F.lit(0)
    labels = rows.groupBy("grp", cell.alias("cell")).agg(F.sum("n").alias("m"))
    labels = labels.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("cell", "m"))).alias("m"))  # at most LABELS + 1 entries
    none = F.create_map().cast("map<int,bigint>")
    vector = F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda c: F.coalesce(F.element_at("m", c), F.lit(0)))
    groups = video.groupBy("grp").agg(F.sum("n").alias("n")).join(labels, "grp", "left").withColumn("m", F.coalesce("m", none))
    groups = cut(groups.select("grp", F.concat(F.array("n"), vector).alias("w")))
    total = groups.agg(F.count("*"), *[F.sum(F.col("w")[i]) for i in range(cells + 1)]).first()
    n_groups, whole = total[0], np.array([x or 0 for x in total[1:]], dtype=float)
    limit = max(1.0, whole[0] / HEAVY)
    # Each has more than 1/HEAVY of all rows, so there are fewer than HEAVY.
    heavy = groups.where(F.col("w")[0] > limit).orderBy("grp").collect()
    need = share[:, None] * whole
    got: np.ndarray = np.zeros(0, int)
    if heavy:
        w = np.array([r["w"] for r in heavy], dtype=float)
        # The light ones can fill what is lacking, but not undo what is too much.
        got = refine(w, place(w, share[:, None] * whole), share[:, None] * whole, under=0.0)
        np.subtract.at(need, got, w)
    spark = segments.sparkSession
    done = spark.createDataFrame([(r["grp"], names[s]) for r, s in zip(heavy, got)], "grp string, split_name string")
    lack = np.maximum(need, 0)
    portion = lack / np.where(lack.sum(axis=0) > 0, lack.sum(axis=0), 1)
    shards = max(1, math.ceil(n_groups / shard_groups))

    def place_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("grp")
        w = np.array(pdf["w"].tolist(), dtype=float)
        target = portion * w.sum(axis=0)
        return pd.DataFrame({"grp": pdf["grp"], "split_name": [names[i] for i in refine(w, place(w, target.copy()), target)]})

    light = groups.where(F.col("w")[0] <= limit).withColumn("shard", F.pmod(F.xxhash64("grp"), F.lit(shards))).groupBy("shard").applyInPandas(place_shard, "grp string, split_name string")
    return video.join(light.unionByName(done), "grp").select("youtube_id", "split_name", F.col("n").alias("n_rows"))


def label_balance(segments: DataFrame, meta: DataFrame, plan: DataFrame) -> DataFrame:
    """(label, split_name, rows, share_pct): the rows of each label by split, and its share of
    the label's rows."""
    labelled = assign_splits(segments, meta, plan).join(latest_crawl(meta, "categories").select("youtube_id", F.explode("categories").alias("label")), "youtube_id")
    count = labelled.groupBy("label", "split_name").agg(F.sum("n_rows").alias("rows"))
    return count.withColumn("share_pct", F.round(100 * F.col("rows") / F.sum("rows").over(Window.partitionBy("label")), 3))  # a row a label and split


def split_rows(segments: DataFrame, meta: DataFrame, plan: DataFrame) -> DataFrame:
    """(record_id, seg_idx, youtube_id, split_name): each row that names a video, once."""
    rows = segments.select("record_id", "seg_idx", "youtube_id").distinct()
    return rows.join(assign_splits(segments, meta, plan).drop("n_rows"), "youtube_id").select("record_id", "seg_idx", "youtube_id", "split_name")
