"""A session with the settings the library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "contactlake", master: str | None = None, **conf) -> SparkSession:
    """A Spark session with UTC time and adaptive execution.

    Call-site capture for every Python column call is switched off: it only serves
    error messages and multiplies the time to build large expressions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
