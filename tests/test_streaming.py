"""Streaming queries give what the batch forms give."""

from blockwright.operators import carve
from blockwright.streaming import live
from pyspark.sql import functions as F


def source(spark, tmp_path, df, files: int, order: str):
    """df written in order as so many files, read as a stream, one file a batch."""
    path = str(tmp_path / "in")
    rows = df.orderBy(order).collect()
    step = -(-len(rows) // files)
    for k in range(0, len(rows), step):
        spark.createDataFrame(rows[k : k + step], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, name: str, tmp_path, mode: str):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_activity_equals_batch(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.round("value").cast("bigint").alias("value")).limit(200)
    got = run(live.activity(source(spark, tmp_path, ev, 3, "ts"), "ts", "event_type", "value", "6 hours", "1 day"), "act", tmp_path, "append")
    want = ev.groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")
    assert got.count() > 0 and got.exceptAll(want).count() == 0  # windows that the watermark has not passed are still open


def test_sessions_join_at_the_gap(spark, tmp_path):
    rows = [(0, "a"), (60, "a"), (121, "a"), (10_000, "a")]
    df = spark.createDataFrame(rows, "s long, lane string").select(F.timestamp_seconds("s").alias("ts"), "lane")
    got = run(live.sessions(source(spark, tmp_path, df, 1, "ts"), "ts", "lane", late="1 second"), "ses", tmp_path, "append")
    assert sorted(r["n"] for r in got.collect())[:2] == [1, 2]


def test_pack_streams_equal_batch(spark, tmp_path):
    rows = [(v, 100 * k, 100, (9_000 * k + (5_000_000 if k > 40 else 0)) % (1 << 33)) for v in (0, 1) for k in range(60) if k != 50]
    packs = spark.createDataFrame(rows, "volume long, offset long, length long, scr long").withColumns({"video": F.lit(1).cast("bigint"), "audio": F.lit(0).cast("bigint")})
    got = run(live.pack_streams(source(spark, tmp_path, packs, 4, "offset")), "packs", tmp_path, "append").orderBy("volume", "stream").collect()
    want = carve.pack_streams(packs).orderBy("volume", "stream").collect()
    assert [tuple(r) for r in got] == [(r["volume"], r["stream"], r["packs"], r["bytes"], r["kept"]) for r in want if r["stream"] < 5100]


def test_silence_retires_streams(spark, tmp_path):
    """Streams end by a break, or by 256 MiB of the disk without a pack of theirs, on whichever volume those bytes are; late packs are told."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    quiet = live.SILENCE
    rows = [(0, 100 * k, 100, 9000 * k) for k in range(30)] + [(1, 5000 + 100 * k, 100, 9000 * k) for k in range(10)]  # in batch 0
    rows += [(0, 3000 + 100 * k, 100, 900_000_000 + 9000 * k) for k in range(5)] + [(1, 5500, 100, 0)]  # a break, and a late pack
    rows += [(2, 4 * quiet, 100, 0), (2, 8 * quiet, 100, 0)]
    packs = spark.createDataFrame([(k // 40, *r) for k, r in enumerate(rows)], "n long, volume long, offset long, length long, scr long")
    path = str(tmp_path / "in")
    for part in (packs.where("n = 0"), packs.where("n = 1 and volume < 2"), packs.where(f"offset = {4 * quiet}"), packs.where(f"offset = {8 * quiet}")):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(packs.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run(live.retiring_streams(stream), "retired", tmp_path, "append").collect()
    told = sorted((r["volume"], r["stream"], r["packs"], r["kept"], r["why"]) for r in got)
    assert told == [(0, 0, 30, True, "break"), (0, 3000, 5, False, "silence"), (1, 5000, 10, False, "silence"), (1, 5500, 1, False, "late"), (2, 4 * quiet, 1, False, "silence")]
