"""The folder for checkpoints: the cluster's, or a temporary one in a single-process session."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def ensure(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="millrace-")
    sc.setCheckpointDir(found)
