import random

from helpers import HARD, documents, words

from blockwright.llm import decontam


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prior = 0
        for j, y in enumerate(b):
            prior, row[j + 1] = row[j + 1], prior + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_subsequence_equals_brute_force():
    rng = random.Random(2)
    for _ in range(100):
        a, b = [[rng.choice("abcd") for _ in range(rng.randint(1, 30))] for _ in range(2)]
        masks = {w: sum(1 << k for k, x in enumerate(a) if x == w) for w in set(a)}
        assert decontam.common_subsequence(masks, len(a), b) == lcs(a, b)


def test_planted_items_and_paraphrases(spark):
    rng = random.Random(4)
    items = [words(rng, rng.randint(16, 58), 5000) for _ in range(60)]
    changed = items[3].split()
    for k in range(2, len(changed), 7):
        changed[k] = "other"
    texts = [words(rng, 300, 5000) for _ in range(100)] + [f"{words(rng, 90, 5000)} {items[k].upper()}. {words(rng, 50, 5000)}" for k in range(20)] + [" ".join(changed) + " " + words(rng, 400, 5000)] + HARD
    bench = spark.createDataFrame([*enumerate(items), (60, None), (61, "  ")], "item_id long, text string")
    got = {(r["id"], r["item_id"]) for r in decontam.contaminated(documents(spark, texts), bench).collect()}
    assert got == {(100 + k, k) for k in range(20)} | {(120, 3)}


def test_empty_tables(spark):
    docs, bench = documents(spark, ["some text"]), spark.createDataFrame([(1, "some text that asks")], "item_id long, text string")
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.contaminated(docs.limit(0), bench).count() == 0


def test_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 7)
    rng = random.Random(9)
    items = [words(rng, 20, 4000) for _ in range(20)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = documents(spark, [f"{words(rng, 40, 4000)} {items[k]}" for k in (0, 8, 19)])
    assert {(r["id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()} == {(0, 0), (1, 8), (2, 19)}


def paraphrase(rng, text, share):
    """The text with this share of its words, at random places, replaced."""
    out = text.split()
    for k in rng.sample(range(len(out)), round(share * len(out))):
        out[k] = f"other{rng.randrange(5000)}"
    return " ".join(out)


def test_paraphrases_are_found_and_clean_texts_left_alone(spark):
    """Items of 30 words with up to 40 % of the words replaced; texts of the same vocabulary, some words of which all texts use."""
    rng = random.Random(21)
    text = lambda n: " ".join(rng.choice(("the", "of", "and")) if rng.random() < 0.3 else f"w{rng.randrange(3000)}" for _ in range(n))
    items = [text(30) for _ in range(200)]
    planted = {share: [f"{text(70)} {paraphrase(rng, items[k], share)} {text(60)}" for k in range(100)] for share in (0.0, 0.2, 0.4)}
    clean = [text(300) for _ in range(1000)]
    texts = [x for some in planted.values() for x in some] + clean
    got = {(r["id"], r["item_id"]) for r in decontam.contaminated(documents(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    found = [sum((at + k, k) in got for k in range(100)) for at in (0, 100, 200)]
    assert found[0] == found[1] == 100 and found[2] >= 90, found
    assert len({i for i, k in got if i >= 300}) <= 2 and len(got) - sum(found) <= 4


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "solo"), (2, "two words"), (3, "one small item of six words")], "item_id long, text string")
    texts = ["with solo here", "words two", "these are two words too", "one small item with six words", "one small item of six words", "nothing"]
    got = {(r["id"], r["item_id"]) for r in decontam.contaminated(documents(spark, texts), bench).collect()}
    assert got == {(0, 1), (2, 2), (4, 3)}


def test_candidates_come_from_the_latent_space():
    """Rank, and cosines of the sketch's vectors against those of a full decomposition."""
    import numpy as np

    rng = np.random.default_rng(22)
    words = [f"w{k}" for k in range(400)]
    items = [(k, [words[j] for j in rng.choice(400, 20)]) for k in range(30)]
    block = decontam.Block(items)
    at = {w: k for k, w in enumerate(block.terms)}
    passages = [sorted({at[words[j]] for j in rng.choice(400, 30) if words[j] in at}) for _ in range(500)]
    rows = np.zeros((500, len(at)))
    for k, p in enumerate(passages):
        rows[k, p] = 1
    space = decontam.Space(block, rows.sum(axis=0), rows.T @ (rows @ block.sketch), 500)
    assert space.basis.shape[1] <= len(items) + decontam.EXTRA
    whole = np.zeros((30, len(at)))
    for k, t in enumerate(block.of):
        whole[k, t] = 1
    whole *= space.weight
    more = decontam.ITEMS * ((rows * space.weight) ** 2).sum() / (whole**2).sum()
    _, values, right = np.linalg.svd(np.concatenate((rows * space.weight, np.sqrt(more) * whole)), full_matrices=False)
    kept = (whole / np.linalg.norm(whole, axis=1, keepdims=True)) @ np.linalg.qr(space.basis / space.weight[:, None])[0]
    assert (np.linalg.norm(kept, axis=1) > 0.8).all()
    assert np.allclose(space.singular[:10], values[:10], rtol=0.2)
