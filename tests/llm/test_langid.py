import random

import numpy as np
from helpers import HARD, documents

from blockwright.llm import langid

ALPHABETS = {"aa": "abcde", "bb": "vwxyzé"}


def corpus(n=160, seed=6):
    rng = random.Random(seed)
    texts, langs = [], []
    for k in range(n):
        lang = ("aa", "bb")[k % 2]
        texts.append(" ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randint(2, 7))) for _ in range(40)))
        langs.append(lang)
    return texts, langs


def test_held_out_accuracy_and_hard_cases(spark):
    texts, langs = corpus()
    df = documents(spark, texts + HARD + ["123 456"], langs + [None] * (len(HARD) + 1))
    rows = {r["id"]: r for r in langid.identify(df).collect()}
    right = [rows[k]["lang_pred"] == langs[k] for k in range(len(texts)) if rows[k]["held_out"]]
    assert len(right) > 30 and np.mean(right) > 0.95
    assert [rows[len(texts) + k]["lang_pred"] for k in (0, 1, 2)] == ["und"] * 3 and rows[len(texts) + len(HARD)]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_gradients_equal_differences():
    langid_units = langid.Network(["a", "b"], seed=1)
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 256, (5, 3))
    target, inside = np.array([0, 1, 1]), np.ones((5, 3), np.float32)
    for k, w in langid_units.weights.items():
        langid_units.weights[k] = w.astype(np.float64)
    _, grads = langid_units.gradients(codes, target, inside)
    for k in ("uf", "cb", "v", "o", "ub"):
        w = langid_units.weights[k]
        at = (0,) * w.ndim
        w[at] += 1e-3
        up, _ = langid_units.gradients(codes, target, inside)
        w[at] -= 2e-3
        down, _ = langid_units.gradients(codes, target, inside)
        w[at] += 1e-3
        assert abs((up - down) / 2e-3 - grads[k][at]) < 2e-4, k


def test_without_labels_and_empty_table(spark):
    df = documents(spark, ["abc"], [None])
    assert [r["lang_pred"] for r in langid.identify(df).collect()] == ["und"]
    assert langid.identify(df.limit(0)).count() == 0
