"""Inputs that several plans share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import micros, plus_seconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recordings: the type is the camera, the value the length in seconds; times in whole microseconds."""
    start = micros(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("camera"), start.alias("s"), plus_seconds(start, F.col("value")).alias("e"))


#: The same in DuckDB.
RECORDINGS = "rec AS (SELECT event_id, user_id, event_type AS camera, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) AS e FROM events)"
