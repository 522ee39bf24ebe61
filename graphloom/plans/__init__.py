"""Query plans over the driver tables."""

from __future__ import annotations

from graphloom.plans.queries import ORACLES, QUERIES  # noqa: E402


def registry():
    """(queries by name, SQL by name)."""
    return QUERIES, ORACLES
