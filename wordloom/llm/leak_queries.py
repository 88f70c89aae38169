"""Problem 8: evaluation items in the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from .leaks import leaked, near_leaks


def p8_found(spark, d):
    return leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark, d):
    """The items that leaked, each with the number of documents that hold it."""
    return p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"))


def p8_near(spark, d):
    """Documents with passages that say nearly what an item says."""
    return near_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id", F.round("share", 4).alias("share"))


_PAIRS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '<[^<>]*>|\d\d:\d\d:\d\d\.\d\d\d', ' ', 'g'), '[a-z0-9]+') w FROM documents WHERE text <> ''),
i AS (SELECT item_id, regexp_extract_all(regexp_replace(lower(text), '<[^<>]*>|\d\d:\d\d:\d\d\.\d\d\d', ' ', 'g'), '[a-z0-9]+') w FROM eval_items WHERE text <> ''),
dw AS (SELECT doc_id, array_to_string(w[k:k+11], ' ') s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) k FROM d WHERE len(w) >= 12)),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k+11], ' ') s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) k FROM i WHERE len(w) >= 12)),
p AS (SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (s))
"""

QUERIES = {"p8_found": p8_found, "p8_items": p8_items, "p8_near": p8_near}
SQL = {"p8_found": _PAIRS + "SELECT doc_id, item_id FROM p", "p8_items": _PAIRS + "SELECT item_id, count(*) AS n_docs FROM p GROUP BY 1"}
