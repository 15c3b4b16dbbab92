"""Registered queries: one per operator, each with the SQL it has to agree with where SQL can say it."""

from __future__ import annotations

import importlib

from verdant.queries.registry import ORACLES, QUERIES

AREAS = (
    "pixels", "clusters", "relational", "keys", "geometry",
    "weather", "features", "text", "search", "graph", "chat", "streams",
)


def load() -> tuple[dict, dict]:
    for area in AREAS:
        importlib.import_module(f"verdant.queries.{area}")
    return dict(QUERIES), dict(ORACLES)
