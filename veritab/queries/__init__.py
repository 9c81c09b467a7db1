"""Registered queries over the driver tables, each next to its SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

AREAS = ["metrics", "relational", "profiles", "rowtext", "synthesis", "models", "privacy", "reports", "streams"]


def _area(name: str):
    return importlib.import_module(f"veritab.queries.{name}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for area in AREAS:
        found.update(_area(area).QUERIES)
    return found


def all_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for area in AREAS:
        found.update(_area(area).SQL)
    return found
