"""Problem 9: documents that hold template residue, filler, errors or notices."""

from __future__ import annotations

from ..session import table
from .residue import find_residue, without_residue


def p9_found(spark, d):
    return find_residue(table(spark, d, "documents"))


def p9_kept(spark, d):
    return without_residue(table(spark, d, "documents")).select("doc_id")


QUERIES = {"p9_found": p9_found, "p9_kept": p9_kept}
SQL: dict[str, str] = {}
