"""Evaluation tables: test expansion, submission pivot, object naming, lookups, attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expanded_choices(df: DataFrame, choices: Column, condition: str = "cond") -> DataFrame:
    """One row an answer choice, with its place from 0."""
    return df.select("*", F.posexplode(choices).alias(condition, "choice"))


def submission(rows: DataFrame, key: str, cond: str, answer: str, rationale: str, n: int = 4, head: int = 3) -> DataFrame:
    """One row a key: answer_0.. from the row of condition `head`, and
    rationale_conditioned_on_a{i}_{j} from the row of condition i. Both are probability
    arrays. A key with a missing condition has nulls, which complete() turns into an error."""
    cols = [F.max(F.when(F.col(cond) == head, F.col(answer)[j])).alias(f"answer_{j}") for j in range(n)]
    cols += [F.max(F.when(F.col(cond) == i, F.col(rationale)[j])).alias(f"rationale_conditioned_on_a{i}_{j}") for i in range(n) for j in range(n)]
    return rows.groupBy(key).agg(*cols)


def complete(df: DataFrame) -> DataFrame:
    """df, failing on the first null in any column."""
    ok = None
    for c in df.columns:
        ok = F.col(c).isNotNull() if ok is None else ok & F.col(c).isNotNull()
    return df.where(F.coalesce(F.assert_true(ok, F.lit("null in the submission")).isNull(), F.lit(True)))


def named_objects(df: DataFrame, group: str, kind: str, order: str) -> DataFrame:
    """The object's name in its group: 'the kind' for the only one of its kind, else the
    kind with a capital and its rank from 1."""
    many = F.count("*").over(Window.partitionBy(group, kind))
    rank = F.row_number().over(Window.partitionBy(group, kind).orderBy(order))
    return df.withColumn("obj_name", F.when(many == 1, F.concat(F.lit("the "), kind)).otherwise(F.concat(F.initcap(kind), F.lit(" "), rank.cast("string"))))


def joined_names(names: Column, most: int = 2) -> Column:
    return F.array_join(F.slice(names, 1, most), " and ")


def running_source_index(df: DataFrame, record: str, order: str, source: str) -> DataFrame:
    """first_of_source and src_index: a record's sources numbered in order, a new number
    wherever the source differs from the row before; nulls are equal to nulls."""
    w = Window.partitionBy(record).orderBy(order)
    new = ~F.col(source).eqNullSafe(F.lag(source).over(w)) | (F.row_number().over(w) == 1)
    out = df.withColumn("first_of_source", new)
    return out.withColumn("src_index", F.sum(F.col("first_of_source").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)


def visible_pairs(df: DataFrame, record: str, pos: str, source: str, valid: Column) -> DataFrame:
    """(record, pos_a, pos_b) of valid rows of one source in one record. Records have a
    fixed number of rows, so the pairs grow with the records only."""
    a = df.where(valid).select(record, source, F.col(pos).alias("pos_a"))
    return a.join(a.withColumnRenamed("pos_a", "pos_b"), [record, source]).select(record, "pos_a", "pos_b")


def lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """An equi-join that must match; which side is broadcast, if any, is left to the optimiser,
    which knows their bytes. Of several rows of a key the last by all columns counts."""
    rest = [c for c in table.columns if c != key]
    one = table.groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest], F.lit(True).alias("_there"))
    out = df.join(one, key, "left")
    there = F.assert_true(F.coalesce("_there", F.lit(False)), F.concat(F.lit("no match for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return out.where(F.coalesce(there.isNull(), F.lit(True))).drop("_there")
