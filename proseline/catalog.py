"""Registered queries over the driver's tables, each with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proseline.plans import ballots, scores, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**texts.QUERIES, **scores.QUERIES, **ballots.QUERIES}
ORACLE_SQL: dict[str, str] = {**texts.ORACLES, **scores.ORACLES, **ballots.ORACLES}
