"""The folder that driver and executors share, and rows that are made once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the checkpoint folder that it has already.

    A session on one machine that names none (in tests) gets a temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="blockwright-")
    sc.setCheckpointDir(named)
    return named


def once(rows: DataFrame) -> DataFrame:
    """The same rows, made once whatever uses them: a checkpoint in the shared folder, which lost executors do not take along."""
    shared_dir(rows.sparkSession)
    return rows.checkpoint()
