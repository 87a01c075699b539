"""A session with the defaults that the engine's plans assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "lodestone", **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; other settings as given (dots written as double underscores)."""
    builder = SparkSession.builder.appName(app)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
