"""Overlapping and gapped intervals: continuous periods and the gaps between them.

An entity's intervals are sorted by start, each start is compared with the running
maximum of the ends before it, and the starts that lie beyond it open islands that are
labelled cumulatively. One entity may own a third of all rows, so no window ever spans
an entity: intervals are reduced to the greatest end of each start, windowed by (entity,
time bucket), whose rows the bucket's width bounds, and what an earlier bucket
hands on (its greatest end, its number of islands) goes through a summary of one row a
bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time bucket: one hour in milliseconds. Any width gives the same result.
BUCKET_MS = 3_600_000


def to_ms(seconds: Column) -> Column:
    """Seconds as whole milliseconds; null for null, NaN and values out of range."""
    return F.rint(seconds.cast("double") * 1000).try_cast("bigint")


def merged_array(intervals: Column) -> Column:
    """The maximal runs of one row's array<struct<s bigint, e bigint>>, sorted. Touching
    intervals join. A null array gives null, an empty one an empty one."""
    kind = "struct<done:array<struct<s:bigint,e:bigint>>,s:bigint,e:bigint>"
    none = F.lit(None).cast("bigint")
    run = lambda s, e: F.struct(s.alias("s"), e.alias("e"))

    def step(acc: Column, x: Column) -> Column:
        fresh = acc["s"].isNull()
        apart = x["s"] > acc["e"]
        return (
            F.when(fresh, F.struct(acc["done"].alias("done"), x["s"].alias("s"), x["e"].alias("e")))
            .when(apart, F.struct(F.concat(acc["done"], F.array(run(acc["s"], acc["e"]))).alias("done"), x["s"].alias("s"), x["e"].alias("e")))
            .otherwise(F.struct(acc["done"].alias("done"), acc["s"].alias("s"), F.greatest(acc["e"], x["e"]).alias("e")))
        ).cast(kind)

    zero = F.struct(F.array().cast("array<struct<s:bigint,e:bigint>>").alias("done"), none.alias("s"), none.alias("e")).cast(kind)
    done = lambda acc: F.when(acc["s"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(run(acc["s"], acc["e"]))))
    return F.aggregate(F.array_sort(intervals), zero, step, done)


def _reduced(df: DataFrame, entity: Sequence[str], start: str, end: str, bucket: int) -> DataFrame:
    """(_k0.., b, s, e): of each entity's start the greatest end, with its bucket. One row a
    start: a bucket then has at most as many rows as it has starts."""
    keys = [f"_k{i}" for i in range(len(entity))]
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(entity, keys)], F.col(f"`{start}`").cast("bigint").alias("s"), F.col(f"`{end}`").cast("bigint").alias("e"))
    return rows.where("e > s").groupBy(*keys, F.floor(F.col("s") / bucket).alias("b"), "s").agg(F.max("e").alias("e"))


def island_starts(df: DataFrame, entity: Sequence[str], start: str, end: str, bucket: int = BUCKET_MS) -> DataFrame:
    """(entity..., s, before, b): the rows that open an island, with the greatest end
    before them (null for an entity's first) and their bucket. Needs integer times.

    Rows with a null time or with end <= start are left out. Null entities form one
    entity. Columns other than these may have any name; they are not read.
    """
    keys = [f"_k{i}" for i in range(len(entity))]
    rows = _reduced(df, entity, start, end, bucket)
    inner = Window.partitionBy(*keys, "b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("seen", F.max("e").over(inner)).where("seen is null or s > seen")
    reach = rows.groupBy(*keys, "b").agg(F.max("e").alias("top"))
    past = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    reach = reach.select(*[F.col(k).alias(f"r{k}") for k in keys], F.col("b").alias("rb"), F.max("top").over(past).alias("carry"))
    same = F.col("b") == F.col("rb")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"r{k}"))
    far = near.join(reach, same, "left").withColumn("before", F.greatest("seen", "carry"))
    return far.where("before is null or s > before").select(*keys, "s", "before", "b")


def gaps(df: DataFrame, entity: Sequence[str], start: str, end: str, bucket: int = BUCKET_MS) -> DataFrame:
    """(entity..., gap_start, gap_end): the longest stretches between an entity's
    intervals that none of them covers. An empty input gives no rows."""
    found = island_starts(df, entity, start, end, bucket).where("before is not null")
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(entity)], F.col("before").alias("gap_start"), F.col("s").alias("gap_end"))


def periods(df: DataFrame, entity: Sequence[str], start: str, end: str, bucket: int = BUCKET_MS) -> DataFrame:
    """(entity..., period_no, period_start, period_end): the continuous periods, counted
    from 1 in order of time. An island's label is its rank in its bucket plus the islands
    of all earlier buckets; its end is what the next island's start was compared with."""
    keys = [f"_k{i}" for i in range(len(entity))]
    heads = island_starts(df, entity, start, end, bucket)
    inner = Window.partitionBy(*keys, "b").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    ranked = heads.withColumn("at", F.count("*").over(inner))
    past = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    number = heads.groupBy(*keys, "b").agg(F.count("*").alias("n"))
    number = number.select(*[F.col(k).alias(f"r{k}") for k in keys], F.col("b").alias("rb"), F.coalesce(F.sum("n").over(past), F.lit(0)).alias("offset"))
    same = F.col("b") == F.col("rb")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"r{k}"))
    labelled = ranked.join(number, same).select(*keys, (F.col("at") + F.col("offset")).alias("label"), "s", "before")
    ends = labelled.where("before is not null").select(*keys, (F.col("label") - 1).alias("label"), F.lit(None).cast("bigint").alias("s"), F.col("before").alias("e"))
    # The last island ends at the entity's greatest end.
    count = labelled.groupBy(*keys).agg(F.max("label").alias("label"))
    top = _reduced(df, entity, start, end, bucket).groupBy(*[F.col(k).alias(f"r{k}") for k in keys]).agg(F.max("e").alias("e"))
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).eqNullSafe(F.col(f"r{k}"))
    last = count.join(top, whole).select(*keys, "label", F.lit(None).cast("bigint").alias("s"), "e")
    parts = labelled.select(*keys, "label", "s", F.lit(None).cast("bigint").alias("e")).unionByName(ends).unionByName(last)
    out = parts.groupBy(*keys, "label").agg(F.min("s").alias("period_start"), F.max("e").alias("period_end"))
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, entity)], F.col("label").alias("period_no"), "period_start", "period_end")


def segment_and_token_intervals(segments: DataFrame) -> DataFrame:
    """(youtube_id, time_level, s, e): the intervals of both levels in milliseconds.

    Rows that name no video (null or empty youtube_id), miss a time or end no later than
    they start give nothing. Of the token arrays, positions that both have count; a null
    in either, a null playback_speed or an end that isn't greater leaves a position out.
    A row's own token intervals are merged before they are exploded.
    """
    base = segments.select("youtube_id", to_ms(F.col("start_time")).alias("s"), to_ms(F.col("end_time")).alias("e"), F.col("playback_speed").cast("bigint").alias("speed"), "tok_start_times", "tok_end_times")
    base = base.where("youtube_id is not null and youtube_id <> '' and e > s")
    n = F.least(F.size("tok_start_times"), F.size("tok_end_times"))
    pairs = F.zip_with(
        F.slice("tok_start_times", 1, n), F.slice("tok_end_times", 1, n),
        lambda a, b: F.struct((F.col("s") + F.col("speed") * to_ms(a)).alias("s"), (F.col("s") + F.col("speed") * to_ms(b)).alias("e")),
    )
    tokens = F.when(n > 0, merged_array(F.filter(pairs, lambda x: x["e"] > x["s"])))
    level = lambda name, runs: F.transform(runs, lambda x: F.struct(F.lit(name).alias("time_level"), x["s"].alias("s"), x["e"].alias("e")))
    empty = F.array().cast("array<struct<time_level:string,s:bigint,e:bigint>>")
    both = F.concat(level("segment", F.array(F.struct("s", "e"))), F.coalesce(level("token", tokens), empty))
    return base.select("youtube_id", F.explode(both).alias("x")).select("youtube_id", "x.time_level", "x.s", "x.e")


def video_gaps(segments: DataFrame, bucket: int = BUCKET_MS) -> DataFrame:
    """(youtube_id, time_level, gap_start_ms, gap_end_ms)."""
    out = gaps(segment_and_token_intervals(segments), ["youtube_id", "time_level"], "s", "e", bucket)
    return out.withColumnsRenamed({"gap_start": "gap_start_ms", "gap_end": "gap_end_ms"})


def video_periods(segments: DataFrame, bucket: int = BUCKET_MS) -> DataFrame:
    """(youtube_id, time_level, period_no, period_start_ms, period_end_ms)."""
    out = periods(segment_and_token_intervals(segments), ["youtube_id", "time_level"], "s", "e", bucket)
    return out.withColumnsRenamed({"period_start": "period_start_ms", "period_end": "period_end_ms"})
