"""Hash-based uniform numbers that any engine with SHA-256 reproduces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 48


def uniform(seed: int | str, *cols: Column | str) -> Column:
    """u in [0, 1) from the first 12 hex digits of sha256('seed|col|...'); nulls read as ''."""
    parts = [F.lit(str(seed))] + [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << _BITS))


def uniform_sql(seed: int | str, *cols: str) -> str:
    """The same number in DuckDB SQL."""
    parts = ", ".join([f"'{seed}'"] + [f"coalesce(cast({c} as varchar), '')" for c in cols])
    return f"(('0x' || substr(sha256(concat_ws('|', {parts})), 1, 12))::bigint / {float(1 << _BITS)!r})"
