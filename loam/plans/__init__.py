"""Registered queries, each with its SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _load() -> tuple[dict[str, Query], dict[str, str]]:
    from . import catalogue, grids, pieces, planning, relations, scores, searches, texts  # noqa: F401
    from .registry import QUERIES, SQL

    return QUERIES, SQL


def queries() -> dict[str, Query]:
    return dict(_load()[0])


def oracle_sql() -> dict[str, str]:
    return dict(_load()[1])
