"""What the crawl says of a video: its latest row and its channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stripped(c: Column) -> Column:
    """The text without white space of any script around it; null if nothing is left."""
    s = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(s != "", s)


def latest_crawl(meta: DataFrame, *columns: str) -> DataFrame:
    """(youtube_id, channel, columns...): of each video the row with the greatest
    crawled_at, its channel stripped and null where blank. Rows without a youtube_id are
    left out. Of several rows at one time, that with the greatest values is taken, so
    the result doesn't depend on the order of rows; a null time is the earliest.
    """
    top = F.max(F.struct("crawled_at", stripped(F.col("channel_id")).alias("channel"), *columns)).alias("x")
    rows = meta.where("youtube_id is not null and youtube_id <> ''").groupBy("youtube_id").agg(top)
    return rows.select("youtube_id", "x.channel", *[f"x.{c}" for c in columns])
