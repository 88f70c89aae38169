"""Capping records per dominant contributor.

The limit is solved by water-filling over the histogram of contributor sizes (one row a
distinct size, so at most sqrt(2N) rows for N records): the greatest level L such that
no contributor that is cut down to L holds more than its share of what is kept.
Then each contributor's best L records are kept, in two phases, so that a contributor of
a third of all rows never is one group of one task before it is reduced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .crawl import latest_crawl

#: Parts into which a contributor's records are split for the first ranking.
SALTS = 64
#: The largest level for which the second ranking takes the best of all salted groups.
FEW = 10_000


def water_level(df: DataFrame, contributor: str, max_count: int | None, max_share: float | None) -> int | None:
    """The most records a contributor may keep; None where nothing limits it.

    With max_share s the level L satisfies L <= s * sum(min(n_i, L)) + s * free, where free
    counts the records without contributor. The left side is linear and the right one
    concave, so the levels that hold are 0..L*. Between two neighbouring sizes the right
    side is linear, which gives each stretch's own limit; the greatest that holds is L*.
    Where s is so small that no level holds, it is 0. An empty table gives max_count.
    """
    if max_share is None or max_share >= 1:
        share = 1.0
    else:
        share = float(max_share)
    sizes = df.groupBy(contributor).agg(F.count("*").alias("n"))
    hist = sizes.groupBy("n", F.col(contributor).isNull().alias("free")).agg(F.count("*").alias("k"))
    held = hist.where("not free")
    up = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = held.select(
        "n", "k", F.sum(F.col("n") * F.col("k")).over(up).alias("below"), F.sum("k").over(up).alias("done"),
        F.sum("k").over(whole).alias("all"), F.lead("n").over(Window.orderBy("n")).alias("next"),
    )
    # The stretch below the smallest size has no complete contributor.
    first = held.agg(F.min("n").alias("next"), F.sum("k").alias("all")).select(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("below"), F.col("all").alias("above"), "next").where("next is not null")
    rest = steps.select("n", "below", (F.col("all") - F.col("done")).alias("above"), "next")
    free = F.lit((hist.where("free").agg(F.sum("n")).first()[0] or 0) if share < 1 else 0)
    slope = 1 - share * F.col("above")
    limit = F.when(slope > 0, share * (F.col("below") + free) / slope).otherwise(F.lit(float("inf")))
    top = F.least(F.coalesce(F.col("next").cast("double"), F.col("n").cast("double")), limit)
    level = first.unionByName(rest).where(top >= F.col("n") - 1e-9).agg(F.max(F.floor(top + 1e-9)), F.max(F.coalesce("next", "n"))).first()
    if level[0] is None:
        return max_count
    solved = None if level[0] >= level[1] else int(level[0])
    return min((x for x in (solved, max_count) if x is not None), default=None)


def ranks(df: DataFrame, contributor: str, best: Sequence[Column]) -> DataFrame:
    """df with each record's rank in its contributor, whatever its size: rows are sorted by
    ranges, so that a large contributor lies in many partitions, ranked within each, and
    moved on by what the contributor has in the partitions before."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    # Stored, so that rank and count see the same ranges.
    rows = cut(df.repartitionByRange(parts, F.asc(contributor), *best).withColumn("_part", F.spark_partition_id()))
    count = rows.groupBy("_part", contributor).agg(F.count("*").alias("_n"))
    past = Window.partitionBy(contributor).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    count = count.select(F.col("_part").alias("_p"), F.col(contributor).alias("_c"), F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_before"))
    near = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_part", contributor).orderBy(*best)))
    far = near.join(count, (F.col("_part") == F.col("_p")) & (F.col(contributor) == F.col("_c")))
    return far.select(*df.columns, (F.col("_rank") + F.col("_before")).alias("_rank"))


def cap_contributors(df: DataFrame, contributor: str, best: Sequence[Column], max_count: int | None = None, max_share: float | None = None, salts: int = SALTS, few: int = FEW) -> DataFrame:
    """df with the column kept: false for the records a contributor must give up.

    best orders a contributor's records, the best first; it should end in a unique key,
    else ties are broken arbitrarily. Records without contributor (null) are all kept. Up
    to a level of `few`, salted groups are ranked first and only their best ones again;
    beyond it, ranks come from sorted ranges. Both give the same.
    """
    level = water_level(df, contributor, max_count, max_share)
    if level is None:
        return df.withColumn("kept", F.lit(True))
    named = df.where(F.col(contributor).isNotNull())
    free = df.where(F.col(contributor).isNull()).withColumn("kept", F.lit(True))
    if level > few:
        out = ranks(named, contributor, best)
        return out.select(*df.columns, (F.col("_rank") <= level).alias("kept")).unionByName(free)
    near = named.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c != contributor]), F.lit(salts)))
    near = near.withColumn("_near", F.row_number().over(Window.partitionBy(contributor, "_salt").orderBy(*best)))
    lost = near.where(F.col("_near") > level).select(*df.columns, F.lit(False).alias("kept"))
    far = near.where(F.col("_near") <= level).withColumn("_far", F.row_number().over(Window.partitionBy(contributor).orderBy(*best)))
    return far.select(*df.columns, (F.col("_far") <= level).alias("kept")).unionByName(lost).unionByName(free)


def ranked_videos(meta: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Each video once, with its channel, and the order of its quality: expectation,
    then views, both from the greatest, then youtube_id. A null or NaN expectation and a
    null, NaN or negative view_count rank behind all others."""
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    rows = latest_crawl(meta, "_num_coco_objects_expectation", "view_count").select("youtube_id", "channel", number("_num_coco_objects_expectation").alias("quality"), F.when(number("view_count") >= 0, F.col("view_count")).alias("views"))
    return rows, [F.desc_nulls_last("quality"), F.desc_nulls_last("views"), F.asc("youtube_id")]


def capped_videos(meta: DataFrame, max_count: int | None = 8, max_share: float | None = None) -> DataFrame:
    """(youtube_id, channel, quality, views, kept) of every video of the crawl."""
    rows, best = ranked_videos(meta)
    return cap_contributors(rows, "channel", best, max_count, max_share)
