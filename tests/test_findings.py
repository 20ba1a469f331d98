"""Findings on rows written by hand: silence on either side, repeats, empty tables."""

import random

import oracle
from blockwright import registry
from blockwright.operators import findings
from pyspark.sql import functions as F


def test_checks_and_comparisons(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 1), (1, None), (None, None)], "a int, b int")
    assert [r[0] for r in df.select(findings.compared(F.col("a"), F.col("b"))).collect()] == ["agree", "differ", *["not determined"] * 3]
    got = {r["check"]: (r["holds"], r["fails"], r["unknown"]) for r in findings.checked(df, {"same": F.col("a") == F.col("b"), "told": F.col("a").isNotNull()}).collect()}
    assert got == {"same": (1, 1, 3), "told": (3, 2, 0)}
    assert findings.checked(df.where("false"), {"x": F.lit(True)}).collect() == []


def test_lists_against_files(spark):
    listed = spark.createDataFrame([(1, "h"), (2, "h"), (3, None)], "k long, h string")
    there = spark.createDataFrame([(2, "x"), (3, None), (4, "h")], "k long, h string")
    assert sorted(map(tuple, findings.held_together(listed, there, "k", "h").collect())) == [(1, "absent"), (2, "differs"), (3, "equal"), (4, "unlisted")]
    assert sorted((r["k"], r["state"]) for r in findings.statement_states(there, listed, "k", "h").collect()) == [(2, "altered"), (3, "altered"), (4, "not stated")]
    assert findings.earlier_entries(spark.createDataFrame([(1, "a"), (5, "a"), (7, "b"), (9, "a")], "i long, d string"), "i", "d").orderBy("i").collect() == [(5, 1, 3), (9, 1, 3)]


def test_roles_stages_and_regions(spark):
    roles = spark.createDataFrame([("all",), ("some",), ("none",)], "role string")
    rows = spark.range(4)
    seen = findings.visible(rows, roles, "role", {"all": F.lit(True), "some": F.col("id") > 2}).groupBy("role").count().collect()
    assert {r["role"]: r["count"] for r in seen} == {"all": 4, "some": 1} and findings.visible(rows, roles, "role", {}).isEmpty()
    stages = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "q"), ("c", "q"), ("d", "q")], "c string, s string")
    assert dict(map(tuple, findings.stage_states(stages, "c", "s", ["x", "y"], ["x"], 2).collect())) == {"a": "complete", "b": "running", "c": "stalled", "d": "waiting"}
    regions = spark.createDataFrame([(1, 0, 10), (2, 5, 25), (3, 7, 7)], "i long, s long, e long")
    assert sorted(map(tuple, findings.touched_blocks(regions, "i", "s", "e", 10).collect())) == [(0, 2, 1), (1, 1, 2), (2, 1, 2)]


def test_regions_without_length(spark):
    regions = spark.createDataFrame([(1, 0, 10), (2, 5, 25), (3, 7, 7), (4, 10, 10), (5, 33, 33), (6, 42, 39), (7, 47, None)], "i long, s long, e long")
    assert sorted(map(tuple, findings.touched_blocks(regions, "i", "s", "e", 10, points=True).collect())) == [(0, 3, 1), (1, 1, 2), (2, 1, 2), (3, 1, 5)]


def oracle_folder(spark, tmp_path, **tables):
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def events(spark, rows):
    """(event_id, seconds since 2024, user_id, type, value) as the event table."""
    df = spark.createDataFrame(rows, "event_id long, at double, user_id long, event_type string, value double")
    return df.select("event_id", F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.round(F.col("at") * 1_000_000).cast("long")).cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props"))


def test_recordings_without_length_equal_sql(spark, tmp_path):
    d = oracle_folder(spark, tmp_path, events=events(spark, [(1, 10.0, 1, "view", 0.0), (2, 3600.0, 1, "view", 0.0), (3, 7000.0, 1, "view", 900.0), (4, 7200.5, 2, "click", 0.0), (5, 20000.0, 2, "click", 0.0)]))
    got, sql = registry.queries()["s20_u5_preserved_blocks"](spark, d), registry.oracle_sql()["s20_u5_preserved_blocks"]
    assert oracle.rows(got.toPandas()) == oracle.rows(oracle.connection(d).execute(sql).df())


def test_light_switches_with_equal_times_equal_sql(spark, tmp_path):
    """Two readings of one time and different light: the single one is no change, and the run that begins beside it keeps its kind."""
    day, kinds = 18 * 86_400.0, {"ir": 4, "col": 1}
    read = [(1, "col"), (2, "col"), (3, "col"), (4, "ir"), (4, "col"), (5, "col"), (6, "col"), (7, "ir"), (8, "ir"), (9, "ir"), (9, "col"), (10, "ir")]
    d = oracle_folder(spark, tmp_path, events=events(spark, [(k, day + t, kinds[c], "view", 1.0) for k, (t, c) in enumerate(read)]))
    got, sql = registry.queries()["w16_light_switches"](spark, d), registry.oracle_sql()["w16_light_switches"]
    want = oracle.rows(oracle.connection(d).execute(sql).df())
    assert len(want[1]) == 1 and oracle.rows(got.toPandas()) == want


def test_picture_runs_equal_a_hand_count(spark):
    """Runs over many stretches, nulls among them, without a join of rows with what stretches carry on."""
    rng = random.Random(5)
    rows = [(v, 2 * k - 30, rng.choice([1, 1, 1, 2, None]), rng.choice([0, 5, 30])) for v in (1, 2, None) for k in range(120) if rng.random() < 0.8] + [(7, 5, 1, 1)]
    want, last = {}, {}
    for v, at, size, time in sorted(rows, key=str):
        last.setdefault(v, []).append((at, size, time))
    for v, frames in last.items():
        frames.sort(key=lambda x: x[0])
        run = None
        for k, (at, size, time) in enumerate(frames):
            prev = frames[k - 1]
            if not k or at - prev[0] > 4 or abs(time - prev[2]) > 20 or None in (size, prev[1]) or size != prev[1]:
                run = at
            n, _ = want.get((v, run), (0, 0))
            want[v, run] = (n + 1, at)
    frames = spark.createDataFrame(rows, "v long, at long, size int, t long").repartition(3)
    for stretch in (1, 8, 1000):
        got = findings.picture_runs(frames, "v", "at", "t", "size", 4, 20, stretch)
        assert {(r["v"], r["run"]): (r["frames"], r["last"]) for r in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
