import random

import numpy as np
from helpers import HARD, documents, words

from blockwright.llm import quality


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    texts, labels = [], []
    for k in range(300):
        good = k % 3 > 0
        text = words(rng, rng.randint(20, 200))
        texts.append(text if good else " ".join(w.upper() + "!!" if k % 2 else w + "###" for w in text.split()))
        labels.append((k, int(good), 0))
    docs = documents(spark, texts + HARD)
    table = spark.createDataFrame([*labels, (0, 1, 0), (9999, 1, 0), (5, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = {r["id"]: r for r in quality.classify(docs, table).collect()}
    held = [k for k in range(300) if rows[k]["held_out"]]
    assert len(held) > 40 and np.mean([rows[k]["predicted"] == labels[k][1] for k in held]) > 0.95
    assert len(rows) == 300 + len(HARD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows.values())
    assert rows[308]["score"] == rows[309]["score"]  # equal texts


def test_without_labels_and_empty_table(spark):
    docs, table = documents(spark, ["x", None]), spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(docs, table).collect()} == {0.5}
    assert quality.classify(docs.limit(0), table).count() == 0


def test_isotonic_equals_definition():
    n, g = np.array([1.0, 2, 1, 4, 1]), np.array([1.0, 0, 1, 2, 1])
    fit = quality.isotonic(n, g)
    assert (np.diff(fit) >= 0).all() and np.allclose(fit[:2], 1 / 3) and fit[-1] == 1


def test_partition_does_not_change_scores(spark):
    rng = random.Random(5)
    docs = documents(spark, [words(rng, 30) + ("###" if k % 2 else "") for k in range(80)])
    table = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, quality int")
    a, b = ({r["id"]: round(r["score"], 6) for r in quality.classify(docs.repartition(p), table).collect()} for p in (1, 7))
    assert a == b
