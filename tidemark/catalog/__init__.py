"""Ready queries over the test tables, each with an independent SQL check where one exists."""

from __future__ import annotations

import importlib

FAMILIES = ("tabular", "scans", "labelling", "metrics", "logging", "governance", "learning", "streams")


def load_all():
    """Import every family and return (queries, checks)."""
    from tidemark.catalog import registry

    for family in FAMILIES:
        importlib.import_module(f"tidemark.catalog.{family}")
    return registry.QUERIES, registry.ORACLES
