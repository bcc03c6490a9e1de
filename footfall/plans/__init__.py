"""Registered queries: each is a Spark plan over the driver tables plus an
independent DuckDB oracle text (when the operator is SQL-expressible)."""

from footfall.plans.registry import REGISTRY, register  # noqa: F401


def load_all() -> dict:
    """Import every plan module (registration happens at import)."""
    from footfall.plans import (  # noqa: F401
        classify,
        content,
        context,
        frames,
        governance,
        graph,
        ingest,
        reports,
        sessions,
        streams,
        typed,
    )

    return REGISTRY
