"""The session the library expects: UTC, adaptive execution, no UI."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "reportmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; ``conf`` entries win (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
