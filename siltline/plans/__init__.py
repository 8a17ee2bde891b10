"""Registered queries and their SQL, by module."""

from __future__ import annotations

import importlib

MODULES = ["instants", "labels", "questions", "posts", "media", "runs", "more", "inventory", "items", "knowledge", "files"]


def registered() -> tuple[dict, dict]:
    """All core queries and their SQL."""
    queries: dict = {}
    oracle: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"siltline.plans.{name}")
        queries |= module.QUERIES
        oracle |= module.ORACLE
    return queries, oracle
