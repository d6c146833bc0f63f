"""Registered queries, by group of operators."""

from __future__ import annotations

import importlib

from prefmine.queries.registry import ORACLES, QUERIES

GROUPS = [
    "sources", "scalars", "joins", "profiles", "windows", "sampling", "graph",
    "features", "dedup", "flows", "taste", "ratings", "ranking", "chain", "blends", "streams",
]


def load():
    for group in GROUPS:
        importlib.import_module(f"prefmine.queries.{group}")
    return QUERIES, ORACLES
