"""Where checkpoints go."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def ready(spark: SparkSession) -> None:
    """Sees to it that checkpoint() has a folder: that of spark.checkpoint.dir; in a local
    session without that setting, one of our own. On a cluster a folder of one machine
    would be lost with it, so that there the setting is needed."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="loam-")
    sc.setCheckpointDir(at)
