"""Session construction with the settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change results or plans; sizes stay the cluster's own business.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "quern", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session; ``conf`` keys use ``__`` for dots (``spark__ui__enabled="false"``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
