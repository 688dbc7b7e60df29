"""A session with the settings that the views and queries are written for."""

from pyspark.sql import SparkSession


def build_session(name: str = "contestlab", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI arithmetic and adaptive execution; conf overrides anything."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
