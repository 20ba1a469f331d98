"""Operators on rows written by hand, in any order and any number of partitions."""

import random

import pytest
from pyspark.sql import functions as F

from blockwright.functions import columns
from blockwright.operators import detect, intervals, leads, match, sequence, timeline

US = columns.US


def shuffled(spark, rows, schema, seed=0, partitions=3):
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, schema).repartition(partitions)


REC = "camera string, s long, e long, id long"


@pytest.mark.parametrize("stretch", [5, 100, 10_000])
def test_gaps_at_the_threshold(spark, monkeypatch, stretch):
    monkeypatch.setattr(intervals, "STRETCH", stretch)
    rows = [("a", 0, 10, 1), ("a", 70, 80, 2), ("a", 141, 150, 3), ("b", 0, 500, 4), ("b", 10, 20, 5), ("b", 561, 570, 6), ("c", 5, 5, 7), (None, 0, 1, 8), (None, 100, 101, 9)]
    for seed in range(3):
        df = shuffled(spark, rows, REC, seed)
        run = intervals.running_max(df, ["camera"], "s", ["id"], F.col("e"), "m", stretch=stretch)
        assert {r["id"]: r["m"] for r in run.collect()} == {1: None, 2: 10, 3: 80, 4: None, 5: 500, 6: 500, 7: None, 8: None, 9: 1}
        got = {tuple(r) for r in intervals.gaps(df, "camera", "s", "e", "id", 60).collect()}
        assert got == {("a", 80, 141), ("b", 500, 561), (None, 1, 100)}


def test_merge_joins_up_to_the_slack(spark):
    rows = [("a", 0, 10, 1), ("a", 15, 20, 2), ("a", 26, 30, 3), ("a", 1, 2, 4), ("a", 0, 10, 5)]
    got = sorted(tuple(r) for r in intervals.merged(shuffled(spark, rows, REC), ["camera"], "s", "e", "id", 5).collect())
    assert got == [("a", 0, 20, 4), ("a", 26, 30, 1)]
    assert intervals.merged(shuffled(spark, rows, REC).limit(0), ["camera"], "s", "e", "id", 5).count() == 0


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_overlap_join_equals_brute_force(spark, width):
    rng = random.Random(2)
    a = [(k, x := rng.randrange(-50, 50), x + rng.randrange(0, 20)) for k in range(40)]
    b = [(k, x := rng.randrange(-50, 50), x + rng.randrange(0, 20)) for k in range(40)]
    left, right = shuffled(spark, a, "i long, s long, e long"), shuffled(spark, b, "j long, bs long, be long")
    for strict in (True, False):
        got = sorted((r["i"], r["j"]) for r in intervals.overlap_join(left, right, "s", "e", "bs", "be", width, strict).collect())
        want = sorted((i, j) for i, s, e in a for j, bs, be in b if (s < be and e > bs if strict else s <= be and e >= bs))
        assert got == want


def test_as_of_both_ways(spark):
    left = shuffled(spark, [("a", 10, 1), ("a", 25, 2), ("a", 5, 3), ("b", 10, 4), ("a", 10, 5)], "k string, t long, id long")
    right = shuffled(spark, [("a", 10, 100), ("a", 20, 200), ("a", 20, 210), ("c", 1, 300)], "k string, u long, v long")
    back = {r["id"]: r["v"] for r in intervals.asof_join(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert back == {1: 100, 2: 210, 3: None, 4: None, 5: 100}
    on = {r["id"]: r["v"] for r in intervals.asof_join(left, right, ["k"], "t", "u", ["v"], within=4, forward=True).collect()}
    assert on == {1: 100, 2: None, 3: None, 4: None, 5: 100}


def test_system_wide_gaps(spark):
    rec = spark.createDataFrame([("a",), ("b",)], "camera string")
    found = shuffled(spark, [("a", 0, 100), ("b", 50, 120), ("a", 500, 600), ("b", 600, 700)], "camera string, gap_start long, gap_end long")
    got = {(r["camera"], r["gap_start"]): (r["shared_with"], r["system_wide"]) for r in timeline.shared_gaps(found, rec).collect()}
    assert got == {("a", 0): (1, True), ("b", 50): (1, True), ("a", 500): (0, False), ("b", 600): (0, False)}
    one = timeline.shared_gaps(found.where("camera = 'a'"), rec.where("camera = 'a'")).collect()
    assert not any(r["system_wide"] for r in one)


def test_recurring_counts_days_not_times(spark):
    day, ten = 86_400 * US, 600 * US
    rows = [("a", d * day + 5 * ten + k, 0) for d, k in ((0, 1), (0, 2), (1, 3))] + [("b", d * day + 5 * ten, 0) for d in range(3)]
    got = [tuple(r) for r in timeline.recurring(shuffled(spark, rows, "camera string, gap_start long, gap_end long")).collect()]
    assert got == [("b", 5, 3, 3)]


def test_explained_silences(spark):
    s = US
    silences = spark.createDataFrame([(0, 100 * s), (1000 * s, 1100 * s), (5000 * s, 5100 * s)], "s long, e long")
    on = spark.createDataFrame([(130 * s,), (1050 * s,), (1060 * s,)], "t long")
    off = spark.createDataFrame([(-700 * s,), (200 * s,)], "t long")
    got = {r["a"] // s: (r["verdict"], r["on_us"] and r["on_us"] // s) for r in timeline.explained_silences(silences, on, off).collect()}
    assert got == {0: ("power_cut", 130), 1000: ("power_cut", 1050), 5000: ("silence_not_in_log", None)}


def test_log_shift_finds_the_offset(spark):
    hour = 3600 * US
    on = spark.createDataFrame([(k * 7 * hour,) for k in range(20)], "t long")
    starts = spark.createDataFrame([(k * 7 * hour + 2 * hour + 30 * US,) for k in range(20)], "s long")
    scores = timeline.log_shift(on, starts)
    assert scores.count() == 57
    got = timeline.shift_verdict(scores.where("shift_min between -180 and 180")).first()
    assert got["shift_min"] == 120 and got["verdict"] == "determined" and got["best"] == 20


def test_wraps_repeats_and_states(spark):
    one = spark.range(1)
    step = lambda a, b, bits: one.select(columns.wrapped_difference(F.lit(a).cast("bigint"), F.lit(b).cast("bigint"), bits)).first()[0]
    assert (step(5, 65_530, 16), step(65_530, 5, 16), step(0, (1 << 33) - 1, 33)) == (11, -11, 1)
    rows = [("a", k, n) for k, n in enumerate((1, 2, 2, 1, 3, 7, 5, 8))]
    kept = sequence.not_repeated(shuffled(spark, rows, "k string, at long, n long"), ["k"], "at", [], "n", stretch=2)
    assert sorted(r["n"] for r in kept.collect()) == [1, 2, 3, 7, 8]
    rows = [("a", 0, 0, False), ("a", 1, 1, True), ("a", 2, 2, False), ("a", 3, 5, False), ("a", 4, 6, False), ("a", 5, 7, True), ("a", 6, 8, False)]
    df = shuffled(spark, rows, "k string, at long, n long, key boolean")
    got = sequence.decode_classes(df, ["k"], "at", F.col("key"), "n", stretch=3).orderBy("at").collect()
    assert [r["state"] for r in got] == ["before_key", "clean", "clean", "after_gap", "after_gap", "clean", "clean"]


def test_upper_medians(spark):
    df = shuffled(spark, [("a", v) for v in (4, 1, 3, 2)] + [("b", 9)], "k string, v long")
    assert dict(df.groupBy("k").agg(columns.upper_median(F.col("v"))).collect()) == {"a": 3, "b": 9}
    assert {r["k"]: r["median"] for r in sequence.lane_median(df, "k", "v").collect()} == {"a": 3, "b": 9}
    cells = shuffled(spark, [("a", k, v) for k, v in enumerate([5, 1, 4, 2, 3, 9, 7])], "k string, at long, v long")
    for block in (2, 100):
        got = sequence.local_index(cells, "k", "at", "v", 1, block).orderBy("at").collect()
        assert [r["local_median"] for r in got] == [5, 4, 2, 3, 3, 7, 9]


def test_region_classes(spark):
    rows = [(100, 1 << 20, 0.5, 0), (1, 1 << 20, 0.01, 0), (1, 1 << 20, 0.5, 0), (1, 1 << 20, 0.99, 3), (1, 1 << 20, 0.99, 0), (4, 0, 0.0, 0)]
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], "k int, codes double, length double, density double, hits double")
    got = [r[0] for r in df.orderBy("k").select(detect.region_class(F.col("codes"), F.col("length"), F.col("density"), F.col("hits"))).collect()]
    assert got == ["video", "empty", "structured", "container_without_video", "unstructured", "empty"]


def test_labels(spark):
    index = spark.createDataFrame([(1, 3, 100, 200, 9), (1, 4, 100, 300, 5), (2, 5, 1000, 1100, 1)], "block long, channel long, start long, end long, at long")
    streams = spark.createDataFrame([(1, 1, 90, 210), (2, 1, 150, 290), (3, 2, 5, 10), (4, 2, 1050, 9999), (5, 7, 1, 2)], "id long, blk long, a long, z long")
    got = {r["id"]: r["label"] for r in match.range_label(streams, index, "blk", "a", "z", 60).collect()}
    assert got == {1: "CH04", 2: "CH04", 3: "stale_tail", 4: "outside_index", 5: "outside_index"}
    tally = spark.createDataFrame([(1, "x", 9), (1, "y", 1), (2, "x", 8), (2, "y", 2)], "s long, l string, n long")
    assert {r["s"]: r["label"] for r in match.majority_label(tally, "s", "l", "n").collect()} == {1: "x", 2: "mixed-evidence"}


def test_budget_stops_at_the_first_overflow(spark):
    df = shuffled(spark, [(0, 40), (1, 40), (2, 40), (3, 1)], "k long, n long")
    assert sorted(r["k"] for r in match.within_budget(df, "k", "n", 100, 2).collect()) == [0, 1]
    assert match.within_budget(df, "k", "n", 1000, 2).count() == 4


def test_increasing_chain_equals_brute_force():
    rng = random.Random(3)
    for _ in range(50):
        v = [rng.randrange(10) for _ in range(rng.randrange(9))]
        parts = [[v[k] for k in range(len(v)) if m >> k & 1] for m in range(1 << len(v))]
        best = max(len(p) for p in parts if all(x < y for x, y in zip(p, p[1:])))
        chain = match.increasing_chain(v)
        assert len(chain) == best and all(v[a] < v[b] and a < b for a, b in zip(chain, chain[1:]))


def test_confusion_leaves_out_what_cannot_be_judged(spark):
    df = spark.createDataFrame([(1, True), (1, False), (0, True), (None, True)], "t int, g boolean")
    r = leads.confusion(df, F.col("t") == 1, F.col("g"), []).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["precision"]) == (1, 1, 1, 0, 0.5)
    assert leads.confusion(df.where("t = 0"), F.col("t") == 1, F.col("g"), []).first()["recall"] is None


def test_utc_needs_a_zone(spark):
    df = spark.createDataFrame([(10 * US, 60, 3), (10 * US, None, 3), (10 * US, 0, None)], "s long, z int, d int")
    assert [r[0] for r in df.select(columns.to_utc(F.col("s"), F.col("z"), F.col("d"))).collect()] == [(10 - 3 - 3600) * US, None, 10 * US]


def test_sun_height(spark):
    # Noon of an equinox at the equator: overhead; midnight: below.
    df = spark.createDataFrame([(1_710_936_420 * US,), ((1_710_936_420 + 43_200) * US,)], "t long")
    up, down = (r[0] for r in df.select(columns.solar_elevation(F.col("t"), 0.0, 0.0)).collect())
    assert up > 89 and down < -85


def test_log_shift_goes_by_bins(spark):
    """Shifts equal counting by hand, at the edges of bins and before 1970 too, and no order over a whole day is needed."""
    from blockwright.operators import timeline

    rng = random.Random(5)
    on, starts = [rng.randrange(-4000, 9000) for _ in range(150)] + [None, 0, 120, 0], [rng.randrange(-4000, 9000) for _ in range(60)] + [None, 120, 240, 360]
    as_rows = lambda values, name: spark.createDataFrame([(v if v is None else v * 1_000_000,) for v in values], f"{name} long")
    got = timeline.log_shift(as_rows(on, "t"), as_rows(starts, "s"), span_min=60, step_min=7)
    want = {}
    for k in range(-60, 61, 7):
        want[k] = (len(on), sum(t is not None and any(s is not None and 0 <= s - t - k * 60 <= 120 for s in starts) for t in on))
    assert {r["shift_min"]: (r["power_ons"], r["followed"]) for r in got.collect()} == want
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
