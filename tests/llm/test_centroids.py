"""Annulus search against every-pair search, and the query against its SQL and hard rows."""

import hashlib
import math

import numpy as np
import oracle
import pytest

from blockwright.llm import centroids, queries


@pytest.mark.parametrize("k", [1, 2, 16, 60])
def test_annulus_finds_the_nearest_with_ties(k):
    rng = np.random.default_rng(k)
    x = rng.integers(-3, 4, (500, 4))
    c = rng.integers(-3, 4, (k, 4))  # many equal distances and equal centroids
    d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    number, distance = centroids.nearest(x, c)
    assert (number == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


def test_annulus_of_vectors_on_its_boundary():
    c = np.array([[0, 0], [6, 0], [10, 0]])
    number, distance = centroids.nearest(np.array([[3, 0], [8, 0], [5, 0], [-1, 0]]), c)
    assert number.tolist() == [0, 1, 1, 0] and distance.tolist() == [9, 4, 1, 1]


def by_hand(rows, k, rounds):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    cs = [v for _, v in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        got = [near(v)[1] for _, v in kept]
        for n in range(len(cs)):
            own = [v for (_, v), g in zip(kept, got, strict=True) if g == n]
            if own:
                cs[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    end = [(i, *near(v)[::-1]) for i, v in kept]
    total = {n: sum(d for _, c, d in end if c == n) for n in range(len(cs))}
    return sorted((i, c, d, total[c], sum(total.values()), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, c, d in end)


def test_hard_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=64).round(3).tolist()) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (5, rows[7][1]), (200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 63 + [None]), (204, [float("nan")] * 64), (205, [float("inf")] * 64), (206, [-0.0] * 64)]
    df = spark.createDataFrame([(i, v, "c", 1.0, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance double, v int")
    for parts in (1, 7):
        got = centroids.cluster(df.repartition(parts))
        assert sorted(map(tuple, got.collect())) == by_hand(rows, 16, 3)
    assert centroids.cluster(df.where("false")).collect() == []
    assert len(centroids.cluster(df.where("vec_id < 4")).collect()) == 4
    huge = spark.createDataFrame([(1, [1e30] * 64), (2, [0.5] * 64), (None, [0.25] * 64)], "vec_id long, embedding array<double>")
    assert {r["id"] for r in centroids.cluster(huge).collect()} == {2, None}


def test_query_equals_sql(spark):
    got = oracle.rows(queries.QUERIES["op13_centroids"](spark, oracle.DATA).toPandas())
    assert got == oracle.rows(oracle.connection().execute(queries.ORACLE_SQL["op13_centroids"]).df())
