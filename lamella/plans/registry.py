"""All registered queries of the library, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamella.plans import corpus, directory, measures, records, scores, space, state

MODULES = [scores, records, directory, corpus, space, state, measures]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
