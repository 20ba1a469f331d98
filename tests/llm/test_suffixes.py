"""Induced sorting against sorting, and the operator against every window of every text."""

import hashlib
import random
from collections import Counter

import helpers
import numpy as np
import pyarrow as pa
import pytest

from blockwright.llm import queries, suffix_dedup, suffixes


@pytest.mark.parametrize("symbols", [1, 2, 3, 40])
def test_suffix_array_is_sorted(symbols):
    rng = random.Random(symbols)
    for _ in range(80):
        t = [rng.randrange(symbols) + 1 for _ in range(rng.randrange(90))] + [0]
        assert suffixes.suffix_array(np.array(t, np.int32), symbols + 1).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_suffix_array_after_a_wide_step():
    """A sweep that stops late in a wide window goes on with a window no wider than a step may be."""
    t = np.append(np.frombuffer(b"dcbbba" * 60_000 + b"dca" * 40_000, np.uint8).astype(np.int32) + 1, np.int32(0))
    sa = suffixes.suffix_array(t, 257)
    rank = np.full(len(t) + 1, -1)
    rank[sa] = np.arange(len(t))
    a, b = sa[:-1], sa[1:]
    assert np.array_equal(np.sort(sa), np.arange(len(t))) and ((t[a] < t[b]) | ((t[a] == t[b]) & (rank[a + 1] < rank[b + 1]))).all()


def covered(texts, length):
    """Flags of bytes in windows that occur twice; every window is counted."""
    windows = Counter(s[i : i + length] for s in texts for i in range(len(s) - length + 1))
    out = []
    for s in texts:
        flags = bytearray(len(s))
        for i in range(len(s) - length + 1):
            if windows[s[i : i + length]] > 1:
                flags[i : i + length] = b"\1" * length
        out.append(flags)
    return out


def spans(flags):
    edges = np.flatnonzero(np.diff(np.concatenate(([0], np.frombuffer(bytes(flags), np.uint8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


@pytest.mark.parametrize("length", [1, 3, 8, 12])
def test_repeated_runs_equal_windows(length):
    rng = random.Random(length)
    for k in range(80):
        texts = [bytes(97 + rng.randrange(2) for _ in range(rng.randrange(50))) for _ in range(rng.randrange(1, 6))]
        texts += texts[:1] * (k % 3)
        assert suffixes.repeated_runs(texts, length) == [spans(f) for f in covered(texts, length)]


def expected(rows):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), text, flags in zip(rows, texts, covered(texts, suffix_dedup.LENGTH), strict=True):
        kept = bytes(b for b, f in zip(text, flags, strict=True) if not f)
        out.append((i, len(text), sum(flags), len(spans(flags)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(4)
    prose = lambda n: helpers.words(rng, n, 5000)
    passage, line = prose(150), "All rights reserved by the people who wrote this fine licence text, in every land and for all of its time. " * 2
    base = prose(400)
    near = []
    for _ in range(40):  # near copies, each with a word of its own somewhere
        w = base.split(" ")
        w[rng.randrange(len(w))] = f"own{rng.random()}"
        near.append(" ".join(w))
    return [
        *helpers.HARD, *near, *(prose(60) + passage + prose(60) for _ in range(20)), *(prose(50) + line + prose(50) for _ in range(30)), "x" * 3000, "ab" * 900, "y" * 400, "y" * 399 + "z", passage[:399], passage[:401],
        base[:700] + "é" + base[700:1400], prose(3000), prose(900) + "same" + (p := prose(80)) + prose(20) + p, "copy " * 400, "copy " * 400,
    ]


def test_removal_equals_every_window(spark):
    rows = list(enumerate(corpus())) + [(3, "again " * 200), (3, "again " * 200), (None, prose := "null " * 300), (9, prose + "!")]
    df = helpers.documents(spark, rows)
    got = suffix_dedup.remove_repeats(df.repartition(5))
    assert sorted(map(tuple, got.drop("removed").collect()), key=str) == expected(rows)


def test_divided_grams_give_the_same(spark):
    """Grams with more stretches than a shard may hold are halved again and again."""
    rows = list(enumerate(corpus()))
    got = suffix_dedup.remove_repeats(helpers.documents(spark, rows), group_bytes=3000, shard_bytes=2000)
    assert sorted(map(tuple, got.drop("removed").collect()), key=str) == expected(rows)


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(helpers.documents(spark, [])).collect() == []


def test_query_equals_every_window(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op11_suffixes"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect()), key=str) == expected([tuple(r) for r in docs])


def test_the_only_kind_of_a_gram_is_not_sorted(monkeypatch):
    """Its copies repeat it whole, one of it repeats nothing; kinds that share a gram are sorted together."""
    rng = random.Random(4)
    make = lambda n: bytes(rng.randrange(32, 127) for _ in range(n))
    body, lone, once = make(420), make(500), make(450)
    rows = [(1, b"a", lone), (1, b"a", lone), (2, b"b", once), (3, b"c", b"x" + body), (3, b"d", body + b"yy"), (4, b"e", lone[:400]), (4, b"e", lone[:400]), (4, b"e", lone[:400])]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], names=["key", "seg", "bytes"])
    sorted_ = []
    whole = suffix_dedup.repeated_runs
    monkeypatch.setattr(suffix_dedup, "repeated_runs", lambda stretches, length: sorted_.extend(stretches) or whole(stretches, length))
    for limit in (1, 1 << 20):
        sorted_.clear()
        got = [r for out in suffix_dedup._sorted_shards(limit)(iter([batch.slice(0, 4), batch.slice(4)])) for r in out.to_pylist()]
        assert {(r["key"], r["seg"]): [(x["s"], x["e"]) for x in r["spans"]] for r in got} == {(1, b"a"): [(0, 500)], (3, b"c"): [(1, 421)], (3, b"d"): [(0, 420)], (4, b"e"): [(0, 400)]}
        assert sorted(sorted_) == sorted([b"x" + body, body + b"yy"])
