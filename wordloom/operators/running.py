"""Running aggregates over keys of any size.

A window over a key would put all its rows into one task. Here rows are windowed by key and
bucket of the order column, and each bucket gets what the buckets before it add up to from a
summary of one row a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KINDS = {"max": (F.max, F.greatest), "min": (F.min, F.least)}


def running(df: DataFrame, keys: list[str], order: str, value: Column, name: str, kind: str = "max", width: float = 100_000) -> DataFrame:
    """df with the running maximum, minimum or sum of value up to and with each row, in the
    order of the numeric column `order`, whose values should differ within a key. Buckets
    are stretches of that column of the given width; any width gives the same. Null values
    are passed over, null keys form one key, rows without order come first."""
    many = F.sum if kind == "sum" else _KINDS[kind][0]
    two = (lambda a, b: F.coalesce(a + b, a, b)) if kind == "sum" else _KINDS[kind][1]
    rows = df.withColumn("_v", value).withColumn("_b", F.coalesce(F.floor(F.col(order) / width).cast("bigint"), F.lit(-(1 << 62))))
    near = rows.withColumn("_near", many("_v").over(Window.partitionBy(*keys, "_b").orderBy(F.asc_nulls_first(order)).rowsBetween(Window.unboundedPreceding, 0)))
    past = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_rb")).agg(many("_v").alias("_m")).withColumn("_carry", many("_m").over(past))
    same = F.col("_b") == F.col("_rb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return near.join(whole, same).select(*df.columns, two(F.col("_near"), F.col("_carry")).alias(name))


def neighbours(df: DataFrame, keys: list[str], order: list[str], bucket: Column, columns: list[str]) -> DataFrame:
    """df with prev_ and next_ of each column: their values in the row before and the row after
    in the order of the key, null at the ends. `bucket` is a number that never falls in that
    order; rows are windowed by key and bucket, and a bucket's ends get their neighbours from
    a summary of one row a bucket. The order should have no ties, else any order among them
    is taken. Null keys form one key."""
    rows = df.withColumn("_b", F.coalesce(bucket.cast("bigint"), F.lit(-(1 << 62))))
    inner = Window.partitionBy(*keys, "_b").orderBy(*order)
    for c in columns:
        rows = rows.withColumn(f"prev_{c}", F.lag(c).over(inner)).withColumn(f"next_{c}", F.lead(c).over(inner))
    rows = rows.withColumn("_first", F.lag(F.lit(1)).over(inner).isNull()).withColumn("_last", F.lead(F.lit(1)).over(inner).isNull())
    at, here = F.struct(*order), F.struct(*columns)
    ends = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_rb")).agg(F.min_by(here, at).alias("_head"), F.max_by(here, at).alias("_tail"))
    outer = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_rb")
    ends = ends.select("*", F.lag("_tail").over(outer).alias("_before"), F.lead("_head").over(outer).alias("_after"))
    same = F.col("_b") == F.col("_rb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = rows.join(ends, same)
    picked = [x for c in columns for x in (F.when(F.col("_first"), F.col(f"_before.{c}")).otherwise(F.col(f"prev_{c}")).alias(f"prev_{c}"), F.when(F.col("_last"), F.col(f"_after.{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}"))]
    return out.select(*df.columns, *picked)
