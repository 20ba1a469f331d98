import random

import numpy as np
import pytest
from helpers import HARD, documents, words
from xxhash import xxh64_intdigest

from blockwright.llm import simhash


def brute_print(text):
    ws = bytes(text or "", "utf-8").lower().split()
    if not ws:
        return 0
    shingles = [b" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)] or [b" ".join(ws)]
    hs = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints: dict):
    ids = sorted(prints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def texts():
    rng = random.Random(1)
    out = list(HARD)
    for _ in range(30):
        base = words(rng, 120)
        out += [base, base.upper(), base.replace(" ", "\n", 5), base + " extra", base.replace("w1", "v1", 1)]
    return out


def test_prints_and_components_equal_brute_force(spark):
    ts = texts()
    prints = {k: brute_print(t) for k, t in enumerate(ts)}
    got = {r["id"]: r for r in simhash.near_duplicates(documents(spark, ts)).collect()}
    assert {k: r["fp"] & (1 << 64) - 1 for k, r in got.items()} == prints
    assert {k: r["component"] for k, r in got.items()} == brute_components(prints)


@pytest.mark.parametrize("group", [8, 4096])
def test_hot_groups_are_divided_and_lose_nothing(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(3)
    fps = set()
    for _ in range(8):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = simhash.hamming_edges(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()
    up = {signed(x): signed(x) for x in fps}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 64
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    want = brute_components({signed(x): x for x in fps})
    assert {i: root(i) for i in up} == want


def test_gray_index_equals_brute_force():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64) & np.uint64(0xFFFF)
    x = np.unique(x)
    x = x[np.argsort(simhash.gray_rank(x), kind="stable")]
    parent = simhash.linked_groups(x, 1, chunk=64)
    for i in range(len(x)):
        for j in range(len(x)):
            if int(x[i] ^ x[j]).bit_count() <= 1:
                assert parent[i] == parent[j]


def test_nulls_and_empty_table(spark):
    df = documents(spark, [(None, "one two three four"), (4, "one two three four"), (4, "one two three four")])
    assert [r["component"] for r in simhash.near_duplicates(df).collect()] == [4, 4, 4]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def jaccard(a, b, width=5):
    def shingles(t):
        w = t.lower().split()
        return {" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(12)
    ts = list(HARD)
    for n in (40, 90, 200):
        for _ in range(12):
            base = words(rng, n, 4000)
            for changes in (0, 1, 2, 5):
                w = base.split()
                for k in rng.sample(range(n), changes):
                    w[k] = "changed"
                ts.append(" ".join(w))
    df = documents(spark, ts)
    got = {r["id"]: r["component"] for r in simhash.near_copies(df).collect()}
    up = list(range(len(ts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    with_words = [k for k, t in enumerate(ts) if t and t.split()]
    for i in with_words:
        for j in with_words:
            if i < j and jaccard(ts[i], ts[j]) >= 0.8:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    groups = {k: root(k) for k in with_words}
    want = {k: r for k, r in groups.items() if list(groups.values()).count(r) > 1}
    assert got == want


def test_divided_groups_keep_near_copies(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 20)
    monkeypatch.setattr(simhash, "PAIRED", 4)
    rng = random.Random(13)
    base = words(rng, 200, 4000).split()
    ts = []
    for k in range(150):
        w = list(base)
        w[rng.randrange(200)] = f"c{k}"
        ts.append(" ".join(w))
    got = {r["component"] for r in simhash.near_copies(documents(spark, ts)).collect()}
    assert got == {0}
    assert simhash.near_copies(documents(spark, ts).limit(0)).count() == 0


def copies_by_brute_force(ts):
    up = list(range(len(ts)))
    sets = []
    for t in ts:
        w = t.lower().split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))})

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ts)):
        for j in range(i + 1, len(ts)):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    groups = [root(k) for k in range(len(ts))]
    return {k: r for k, r in enumerate(groups) if groups.count(r) > 1}


@pytest.mark.parametrize("paired", [32, 2])
def test_near_copies_that_differ_by_a_block(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = random.Random(14)
    ts = []
    for k in range(60):
        base = words(rng, 300, 100000).split()
        more = words(rng, 80, 100000).split()
        at = rng.randrange(250)
        changed = [base + more[:72], base[: 300 - 58], base[:at] + more[:28] + base[at + 28 :]][k % 3]
        ts += [" ".join(base), " ".join(changed)]
    want = copies_by_brute_force(ts)
    assert len(want) == 120
    assert {r["id"]: r["component"] for r in simhash.near_copies(documents(spark, ts)).collect()} == want


def family(rng):
    """A text, and pairs of texts that are similar enough to each other but not to it."""
    base = words(rng, 400, 100000).split()
    ts = [" ".join(base)]
    for k in range(150):
        at = [p * 30 + rng.randrange(20) for p in rng.sample(range(13), 11)]
        for own in (0, 1):
            w = list(base)
            for n, p in enumerate(at):
                w[p] = f"c{k}" if n < 3 else f"c{k}-{own}"
            ts.append(" ".join(w))
    return ts


def test_texts_near_an_unlinked_leader_still_meet(spark):
    ts = family(random.Random(15))
    want = copies_by_brute_force(ts)
    assert 0 not in want and len(want) == 300 and len(set(want.values())) == 150
    assert {r["id"]: r["component"] for r in simhash.near_copies(documents(spark, ts)).collect()} == want


def test_chunks_of_a_list_that_does_not_shrink_meet(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 16)
    monkeypatch.setattr(simhash, "PAIRED", 4)
    ts = family(random.Random(16))
    want = copies_by_brute_force(ts)
    assert 0 not in want and len(want) == 300
    assert {r["id"]: r["component"] for r in simhash.near_copies(documents(spark, ts)).collect()} == want


@pytest.mark.parametrize("passage", [False, True])
@pytest.mark.parametrize("shared", [False, True])
def test_near_copies_inside_a_family_of_one_boilerplate(spark, shared, passage):
    """Pairs at 0.8 or more are found whether or not all texts share most of their words with all others."""
    rng = random.Random(17)
    base, ts = words(rng, 200, 100000).split(), []
    for k in range(500):
        one = list(base) if shared else words(rng, 200, 100000).split()
        for p in rng.sample(range(0, 192, 12), 6):
            one[p + rng.randrange(8)] = f"x{k}-{p}"
        two = list(one)
        at = range(180)[rng.randrange(180)]
        for q in range(12) if passage else (5, 55, 105, 155):
            two[q + at if passage else q] = f"y{k}-{q}"
        ts += [" ".join(one), " ".join(two)]
    pairs = [k for k in range(0, len(ts), 2) if jaccard(ts[k], ts[k + 1]) >= 0.8]
    got = {r["id"]: r["component"] for r in simhash.near_copies(documents(spark, ts)).collect()}
    assert len(pairs) > 450 and all(got.get(k) == k == got.get(k + 1) for k in pairs)


def test_near_copies_of_long_texts_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 50)
    rng = random.Random(18)
    long = words(rng, 3000, 100000)
    rows = [(1, long), (2, long.replace(" ", "  ", 40).upper()), (3, long + " more words at the end"), (3, long + " more words at the end"), (4, "x" * 4000), (None, long), (5, "one two"), (5, "Two one"), (6, "two ONE")]
    got = {(r["id"], r["component"]) for r in simhash.near_copies(documents(spark, rows)).collect()}
    assert {(1, 1), (2, 1), (3, 1)} <= got and {i for i, _ in got} <= {1, 2, 3, 5, 6}


def test_pieces_of_a_text_give_the_same_shingles(monkeypatch):
    rng = random.Random(19)
    for width in (1, 3, 5):
        for n in (0, 1, 2, 3, 4, 5, 6, 40):
            text = words(rng, n, 50)
            monkeypatch.setattr(simhash, "PIECE", 1 << 20)
            whole = [int(h) for part in simhash.shingle_hashes(text, width) for h in part]
            monkeypatch.setattr(simhash, "PIECE", 7)
            assert [int(h) for part in simhash.shingle_hashes(text, width) for h in part] == whole


def test_folded_sketches_bound_the_difference():
    rng = np.random.default_rng(20)
    for n, m in ((10, 12), (700, 650), (3000, 900)):
        both = rng.integers(0, 1 << 63, min(n, m) // 2, dtype=np.uint64)
        a, b = (np.unique(np.concatenate((both, rng.integers(0, 1 << 63, k - len(both), dtype=np.uint64)))) for k in (n, m))
        x, y = simhash.sketch(a), simhash.sketch(b)
        size = min(len(x), len(y))
        assert np.bitwise_count(simhash.folded(x, size) ^ simhash.folded(y, size)).sum() <= len(np.setxor1d(a, b))
