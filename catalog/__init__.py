"""Registered queries: each operator over the driver's tables, with its oracle SQL."""

from __future__ import annotations

from importlib import import_module

_FAMILIES = ("points_q", "analytics_q", "labels_q", "stores_q", "sql_q")


def load():
    """(queries, oracles) with every family imported."""
    for family in _FAMILIES:
        import_module(f"catalog.{family}")
    from catalog.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
