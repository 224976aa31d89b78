"""Catalog of runnable queries over the supplied tables."""

from importlib import import_module

MODULES = [
    "kernel_queries", "grid_queries", "label_queries", "evidence_queries", "frame_queries", "transcript_queries", "voice_queries",
    "timeline_queries", "plan_queries", "store_queries",
]


def load():
    """Import every query module; returns the queries and the SQL texts."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
