"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomfield.plans import aggregates, joins, predicates, ranking, sampling, sources, vectors

PLANS = (sampling, predicates, joins, aggregates, ranking, vectors, sources)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for p in PLANS for k, f in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for p in PLANS for k, s in p.SQL.items()}
