"""A Spark session with the settings that the library counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "newsloom", **conf: str) -> SparkSession:
    """UTC and adaptive execution; anything else stays as the cluster sets it. ``conf`` may override (dots as ``__``)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
