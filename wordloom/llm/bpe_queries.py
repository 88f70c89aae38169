"""Problem 7: the corpus as token ids."""

from __future__ import annotations

from ..session import table
from .bpe import encode_column


def p7_ids(spark, d):
    return encode_column(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {"p7_ids": p7_ids}
SQL: dict[str, str] = {}
