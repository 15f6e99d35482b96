"""All registered queries and their oracle texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from countwatch.plans import corruption_runs, facts, forecast_queries, live_oracle, live_queries, oracle, record_queries, second_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **record_queries.QUERIES,
    **forecast_queries.QUERIES,
    **live_queries.QUERIES,
    **second_path.QUERIES,
    **facts.QUERIES,
    **corruption_runs.QUERIES,
}
ORACLES: dict[str, str] = {**oracle.TEXTS, **live_oracle.TEXTS}
