"""Paths in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_path(spark: SparkSession, tag: str) -> str:
    """spark.checkpoint.dir is that folder; where it is unset and Spark runs on one machine (tests), a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or tempfile.gettempdir()
    return f"{root.rstrip('/')}/roadweave-{tag}-{uuid.uuid4().hex[:12]}"
