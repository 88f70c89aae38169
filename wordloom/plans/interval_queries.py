"""Queries of the interval problem, with their SQL."""

from __future__ import annotations

from ..operators.intervals import video_gaps, video_periods
from ..session import table

_INTERVALS = """
WITH base AS (
  SELECT youtube_id, CAST(round_even(start_time * 1000, 0) AS BIGINT) s, CAST(round_even(end_time * 1000, 0) AS BIGINT) e,
         playback_speed p, tok_start_times a, tok_end_times b
  FROM segment_k2f WHERE youtube_id IS NOT NULL AND youtube_id <> '' AND start_time IS NOT NULL AND end_time IS NOT NULL),
good AS (SELECT * FROM base WHERE e > s),
words AS (
  SELECT youtube_id, s + p * CAST(round_even(CAST(a[i] AS DOUBLE) * 1000, 0) AS BIGINT) s, s + p * CAST(round_even(CAST(b[i] AS DOUBLE) * 1000, 0) AS BIGINT) e
  FROM (SELECT youtube_id, s, p, a, b, unnest(range(1, 1 + least(len(a), len(b)))) i FROM good)),
iv AS (
  SELECT DISTINCT youtube_id, 'segment' time_level, s, e FROM good
  UNION ALL SELECT DISTINCT youtube_id, 'token', s, e FROM words WHERE e > s),
run AS (
  SELECT *, max(e) OVER (PARTITION BY youtube_id, time_level ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM iv)
"""

QUERIES = {
    "p4_found": lambda spark, d: video_gaps(table(spark, d, "segment_k2f")),
    "p4_periods": lambda spark, d: video_periods(table(spark, d, "segment_k2f")),
}

SQL = {
    "p4_found": _INTERVALS + "SELECT youtube_id, time_level, prev AS gap_start_ms, s AS gap_end_ms FROM run WHERE s > prev",
    "p4_periods": _INTERVALS
    + """, lab AS (SELECT *, sum(CASE WHEN prev IS NULL OR s > prev THEN 1 ELSE 0 END) OVER (PARTITION BY youtube_id, time_level ORDER BY s, e ROWS UNBOUNDED PRECEDING) k FROM run)
SELECT youtube_id, time_level, CAST(k AS BIGINT) AS period_no, min(s) AS period_start_ms, max(e) AS period_end_ms FROM lab GROUP BY 1, 2, 3""",
}
