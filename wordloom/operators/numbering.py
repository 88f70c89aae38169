"""Row numbers over a whole table, and joins by them, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def numbered(df: DataFrame, *order: str | Column, name: str = "n", parts: int | None = None) -> DataFrame:
    """df with each row's number from 0 in the given order, and `total`, the number of rows.

    Rows are sorted into ranges, which are stored once, since ranges may fall otherwise when
    they are computed again; a range's rows are numbered by a window, the ranges before it by
    their counts, of which there is one a range. Rows that are equal in the order are
    numbered in any order among them: give an order without ties where that matters. Columns of
    the order are ascending; negate a number for the other way.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = df.select("*", *[c.alias(f"_o{i}") for i, c in enumerate(cols)])
    keys = [f"_o{i}" for i in range(len(cols))]
    rows = cut(keyed.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    count = rows.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy().orderBy("_p")  # one row a range
    before = count.select("_p", (F.sum("_c").over(w) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("total"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return rows.withColumn("_i", inner).join(before, F.col("_part") == F.col("_p")).withColumn(name, F.col("_before") + F.col("_i")).drop("_part", "_p", "_i", "_c", "_before", *keys)


def zipped(a: DataFrame, a_order: list[str], b: DataFrame, b_order: list[str], strict: bool = False) -> DataFrame:
    """The rows of two tables side by side by their places in order, as many as the shorter
    has; strict makes it an error that the second ends before the first."""
    left, right = numbered(a, *a_order, name="n").withColumnRenamed("total", "_left"), numbered(b, *b_order, name="n").withColumnRenamed("total", "_right")
    out = left.join(right, "n")
    if strict:
        fits = F.assert_true(F.col("_left") <= F.col("_right"), F.lit("the second table ends before the first"))
        out = out.where(F.coalesce(fits.isNull(), F.lit(True)))
    return out.drop("_left", "_right")


def shard_of(df: DataFrame, shards: int, shard: int, *order: str) -> DataFrame:
    """Every shards-th row in order, from the shard's number on."""
    return numbered(df, *order, name="_row").where(F.pmod("_row", F.lit(shards)) == shard).drop("_row", "total")


def epochs(df: DataFrame, count: int, seed: int, file: str, hosts: int = 1, host: int = 0) -> DataFrame:
    """Rows of training epochs: the host's files (by hash), each row once an epoch, with the
    epoch and the file's place in it by a hash, so that each epoch has another order."""
    from ..rand import uniform

    mine = df.where(F.pmod(F.xxhash64(file), F.lit(hosts)) == host)
    return mine.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("file_order", uniform(seed, "epoch", file))
