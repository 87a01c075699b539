"""Registered queries: a function from Tables to a DataFrame, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Registers a query. `views` names the catalog views that its SQL reads."""

    def keep(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            with_ = ", ".join(f"{v} as ({VIEWS[v]})" for v in views.split())
            body = sql.strip()
            if with_:
                body = f"with {with_}, {body[5:]}" if body.startswith("with ") else f"with {with_} {body}"
            ORACLE_SQL[name] = body
        return f

    return keep
