"""All queries of the core, gathered from the modules that define them."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("interval_queries", "text_queries", "time_queries", "record_queries", "media_queries", "vector_queries")


def gather(what: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update(getattr(import_module(f"{__package__}.{m}"), what))
    return out
