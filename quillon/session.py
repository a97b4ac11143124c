"""Session helper with the settings the engine is designed around."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quillon", **conf: str) -> SparkSession:
    """Adaptive execution with skew-join splitting, UTC times and Arrow transfer. On a cluster the
    master and the shared ``spark.checkpoint.dir`` come from the submit configuration."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
