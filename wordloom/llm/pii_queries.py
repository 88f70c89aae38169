"""Problem 5: personal information in descriptions."""

from __future__ import annotations

from ..session import table
from .pii import personal_lines, redacted_descriptions


def p5_found(spark, d):
    return personal_lines(table(spark, d, "segment_k2f"))


def p5_redacted(spark, d):
    return redacted_descriptions(table(spark, d, "segment_k2f"))


QUERIES = {"p5_found": p5_found, "p5_redacted": p5_redacted}
SQL: dict[str, str] = {}
