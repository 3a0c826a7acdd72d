"""Session settings the engine is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "barloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf adds or replaces settings."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
