"""Every registered query of the engine, and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.plans import oracles, queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in queries.ALL}
ORACLES: dict[str, str] = oracles.ORACLES
