"""Problem 3: splits that keep videos and channels together."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import table
from .split import assign_splits, channel_roots, joined_channels, label_balance, split_rows


def p3_found(spark, d):
    return joined_channels(table(spark, d, "segment_k2f"), table(spark, d, "meta_info"))


def p3_splits(spark, d):
    return assign_splits(table(spark, d, "segment_k2f"), table(spark, d, "meta_info"), table(spark, d, "split_plan"))


def p3_rows(spark, d):
    return split_rows(table(spark, d, "segment_k2f"), table(spark, d, "meta_info"), table(spark, d, "split_plan"))


def p3_shares(spark, d):
    """Rows and percentage reached by each split."""
    out = p3_splits(spark, d).groupBy("split_name").agg(F.sum("n_rows").alias("rows"), F.count("*").alias("videos"))
    return out.withColumn("share_pct", F.round(100 * F.col("rows") / F.sum("rows").over(Window.partitionBy()), 3))  # a row a split


def p3_members(spark, d):
    """Every channel with the least channel of its component."""
    return channel_roots(table(spark, d, "segment_k2f"), table(spark, d, "meta_info"))


def p3_balance(spark, d):
    """Rows and share of each label by split."""
    return label_balance(table(spark, d, "segment_k2f"), table(spark, d, "meta_info"), table(spark, d, "split_plan"))


_COMPONENTS = r"""
WITH RECURSIVE m AS (SELECT DISTINCT youtube_id, nullif(regexp_replace(channel_id, '^\s+|\s+$', '', 'g'), '') c FROM meta_info WHERE youtube_id IN (SELECT youtube_id FROM segment_k2f WHERE youtube_id <> '')),
e AS (SELECT DISTINCT x.c a, y.c b FROM m x JOIN m y USING (youtube_id) WHERE x.c IS NOT NULL AND y.c IS NOT NULL),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
"""
QUERIES = {"p3_members": p3_members, "p3_balance": p3_balance, "p3_found": p3_found, "p3_splits": p3_splits, "p3_rows": p3_rows, "p3_shares": p3_shares}
SQL = {
    "p3_found": _COMPONENTS + "SELECT a AS channel_a, b AS channel_b FROM r WHERE a < b",
    "p3_members": _COMPONENTS + "SELECT a AS channel, min(b) AS root FROM r GROUP BY 1",
}
