"""Problem 2: packing the token streams into containers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from .pack import pack_segments


def _packed(spark, d):
    return pack_segments(table(spark, d, "segment_k2f"), table(spark, d, "pack_budget"))


def p2_found(spark, d):
    """The items that were cut: each has one part with number 1."""
    return _packed(spark, d).where("part = 1").select("record_id", "seg_idx", "stream_name").distinct()


def p2_placements(spark, d):
    return _packed(spark, d)


def p2_fill(spark, d):
    """Containers, items and the share of the room in use, by stream."""
    boxes = _packed(spark, d).groupBy("stream_name", "shard", "container_no").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"))
    boxes = boxes.join(F.broadcast(table(spark, d, "pack_budget").groupBy("stream_name").agg(F.max("capacity").alias("capacity")).where("stream_name in ('tok_ids', 'random_text')")), "stream_name")
    return boxes.groupBy("stream_name").agg(F.count("*").alias("containers"), F.sum("k").alias("items"), F.sum("t").alias("tokens"), F.round(F.sum("t") / F.sum("capacity"), 4).alias("fill"))


QUERIES = {"p2_found": p2_found, "p2_placements": p2_placements, "p2_fill": p2_fill}
SQL = {
    "p2_found": """
WITH s AS (SELECT record_id, seg_idx, unnest([{'n': 'tok_ids', 'a': tok_ids}, {'n': 'random_text', 'a': random_text}]) x FROM segment_k2f),
l AS (SELECT record_id, seg_idx, x.n AS stream_name, list_max(list_transform(x.a, lambda v, i: CASE WHEN v <> 0 THEN i ELSE 0 END)) n FROM s)
SELECT DISTINCT record_id, seg_idx, l.stream_name FROM l JOIN pack_budget b ON l.stream_name = b.stream_name WHERE n > capacity""",
}
