"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Spark's own reader, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session decides. Only a session on one machine that names none (in tests) gets a
    fresh temporary folder, which is then also the session's checkpoint folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if named:
        if not current.isDefined():
            sc.setCheckpointDir(named)
        return named
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="blockwright-")
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few numbers each that one partition of a small table holds.
PACKED = 1 << 17


def packed(df: DataFrame, rows: int) -> DataFrame:
    """A table of so many short rows in as few partitions as that asks for; a large one keeps those that it has."""
    return df.coalesce(max(1, -(-rows // PACKED)))


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Most bytes and rows of a batch between Spark and its Python workers.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000


def own_session(spark: SparkSession) -> None:
    """Keep batches of texts small for the rest of a session that is the caller's own; smaller settings stay.

    A batch exists several times at once (in Spark, on its way, in the worker), and by rows alone ten thousand long
    texts would be one batch. Scans of one table are cut alike throughout the session, however many executors there are.
    """
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        name = f"spark.sql.execution.arrow.{key}"
        now = int("".join(c for c in spark.conf.get(name) if c.isdigit() or c == "-") or -1)
        if not 0 < now <= most:
            spark.conf.set(name, str(most))
    splits = "spark.sql.files.minPartitionNum"
    if not (spark.conf.get(splits, None) or "").isdigit():
        spark.conf.set(splits, str(max(1, spark.sparkContext.defaultParallelism)))


def text_or_empty(name: str = "text"):
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def give_back() -> None:
    """Return freed memory to the system: workers live on from stage to stage, beside an executor that needs it."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """A function over batches that gives its memory back when it is through."""

    def through(batches):
        yield from run(batches)
        give_back()

    return through


def runs(batch: pa.RecordBatch, sizes: np.ndarray, most: int):
    """Cut a batch into runs of rows whose sizes add up to about ``most``; one larger row is a run of its own."""
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def text_runs(batch: pa.RecordBatch, column: int, most: int):
    """Runs of rows by the bytes of their texts."""
    yield from runs(batch, pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), most)
