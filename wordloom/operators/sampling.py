"""Reproducible sampling: uniform numbers come from hashes of keys, never from row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rand import uniform


def gumbel(weight: Column, u: Column) -> Column:
    """ln(w) - ln(-ln(u)): the k greatest are a weighted sample without replacement."""
    return F.when(weight > 0, F.ln(weight) - F.ln(-F.ln(F.greatest(u, F.lit(1e-15)))))


def weighted_sample(df: DataFrame, k: int, weight: Column, seed: int, *keys: str) -> DataFrame:
    """k rows drawn by weight without replacement (fewer where fewer have weight); the
    global limit is one top-k, taken in each partition first."""
    g = gumbel(weight, uniform(seed, *keys))
    return df.withColumn("_g", g).where("_g is not null").orderBy(F.desc("_g"), *keys).limit(k).drop("_g")


def uniform_sample(df: DataFrame, k: int, seed: int, *keys: str, by: list[str] | None = None) -> DataFrame:
    """k rows drawn evenly, of the table or of each group."""
    u = df.withColumn("_u", uniform(seed, *keys))
    if by is None:
        return u.orderBy("_u", *keys).limit(k).drop("_u")
    return u.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("_u", *keys))).where(F.col("_k") <= k).drop("_u", "_k")


def bernoulli(p: float | Column, seed: int, *keys: str) -> Column:
    return uniform(seed, *keys) < p


def choice(options: list, seed: int, *keys: str) -> Column:
    """One of the options, by hash."""
    i = F.floor(uniform(seed, *keys) * len(options)).cast("int")
    return F.get(F.array(*[F.lit(o) for o in options]), i)


def shuffled(df: DataFrame, parts: int, seed: int, *keys: str) -> DataFrame:
    """The rows in parts of a random order: a lossless shuffle for writing."""
    return df.withColumn("_u", uniform(seed, *keys)).repartitionByRange(parts, "_u").sortWithinPartitions("_u").drop("_u")
