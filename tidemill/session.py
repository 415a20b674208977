"""A session with the settings the queries are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tidemill", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings are added with dots for double underscores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
