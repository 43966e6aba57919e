"""The folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir or set on the context; a local one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"/tmp/checkpoints/{uuid.uuid4().hex}"
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
