"""Sessions with the settings the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "vetstone", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; shuffle partitions are left to the cluster unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
