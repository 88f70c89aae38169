"""All queries of the training-data problems."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("line_queries", "bpe_queries", "leak_queries", "residue_queries", "pii_queries", "cap_queries", "pack_queries", "split_queries")


def gather(what: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update(getattr(import_module(f"{__package__}.{m}"), what))
    return out
