"""The folder that driver and executors share, for checkpoints: spark.checkpoint.dir, or a temporary one in local sessions only."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    kept = sc._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return found or kept.get()
    if not found and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="sqlatlas-"))
    return found or sc._jsc.sc().getCheckpointDir().get()
