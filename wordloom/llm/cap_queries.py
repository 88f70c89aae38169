"""Problem 6: capping the videos of a channel."""

from __future__ import annotations

from ..session import table
from .cap import capped_videos

_LATEST = r"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY youtube_id ORDER BY crawled_at DESC) k FROM meta_info WHERE youtube_id <> ''),
v AS (SELECT youtube_id, nullif(regexp_replace(channel_id, '^\s+|\s+$', '', 'g'), '') AS channel_id,
  CASE WHEN isnan(_num_coco_objects_expectation) THEN NULL ELSE _num_coco_objects_expectation END q,
  CASE WHEN view_count >= 0 AND NOT isnan(view_count) THEN view_count END w FROM r WHERE k = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY q DESC NULLS LAST, w DESC NULLS LAST, youtube_id) n FROM v)
"""


def p6_found(spark, d):
    return capped_videos(table(spark, d, "meta_info")).where("not kept").selectExpr("channel as channel_id", "youtube_id")


def p6_kept(spark, d):
    return capped_videos(table(spark, d, "meta_info")).where("kept").selectExpr("channel as channel_id", "youtube_id")


def p6_share_capped(spark, d):
    """No channel keeps more than 2 % of the kept videos."""
    return capped_videos(table(spark, d, "meta_info"), max_count=None, max_share=0.02).where("kept").selectExpr("channel as channel_id", "youtube_id")


QUERIES = {"p6_found": p6_found, "p6_kept": p6_kept, "p6_share_capped": p6_share_capped}
SQL = {
    "p6_found": _LATEST + "SELECT channel_id, youtube_id FROM o WHERE channel_id IS NOT NULL AND n > 8",
    "p6_kept": _LATEST + "SELECT channel_id, youtube_id FROM o WHERE channel_id IS NULL OR n <= 8",
    "p6_share_capped": _LATEST
    + """, c AS (SELECT channel_id, count(*) n FROM v GROUP BY 1), lv AS (SELECT unnest(range(0, (SELECT max(n) + 1 FROM c WHERE channel_id IS NOT NULL))) L),
t AS (SELECT L, sum(CASE WHEN channel_id IS NULL THEN n ELSE least(n, L) END) total FROM c, lv GROUP BY L),
b AS (SELECT max(L) L FROM t WHERE L <= 0.02 * total + 1e-9)
SELECT channel_id, youtube_id FROM o, b WHERE channel_id IS NULL OR n <= L""",
}
