"""A folder that driver and executors share, for tables that outlive a stage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path in the cluster's checkpoint folder; in local sessions that set none, in a temporary one."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="scratch-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/store-{uuid.uuid4().hex}"
