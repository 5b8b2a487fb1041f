"""Where intermediate files go: a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; only a local session may go without that setting."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir")
    if not at:
        if not (conf.get("spark.master") or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="helixsieve-")
    return f"{at.rstrip('/')}/helixsieve/{name}-{uuid.uuid4().hex}"
