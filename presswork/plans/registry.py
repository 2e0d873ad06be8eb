"""Name -> query, and name -> the SQL that gives the same rows; gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from presswork.plans.bindings import Tables

FLAGSHIP = "c2_feed_manual"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the tables under a name, with its SQL unless SQL can't express it."""

    def register(build: Callable[[Tables], DataFrame]):
        @wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return build

    return register


from presswork.plans import catalog_queries, content_queries, experiment_queries, feed_queries, frame_queries, function_queries, job_queries, live_queries, metric_queries, profile_queries, relational_queries, resolve_queries, search_queries, source_queries, state_queries, stream_queries  # noqa: E402, F401
