"""Materialised intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def materialised(df: DataFrame, name: str = "step") -> DataFrame:
    """Write and reread: later plans start from a scan instead of all expressions before it. The
    folder is ``spark.checkpoint.dir``; a local one is set only where the session has none."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/quillon-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
