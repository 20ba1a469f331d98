"""Pointer doubling against following each head, and calibration against planted bases."""

import random

import pytest
from blockwright.operators import chains

SLOT = "volume long, idx long, kind int, next long, prev long, seq long"


def followed(rows):
    out = {}
    for volume in {r[0] for r in rows}:
        at = {r[1]: r for r in rows if r[0] == volume}
        for head in (i for i, r in at.items() if r[2] == 1):
            chain, note, now = [head], "", at[head]
            while k := now[3]:
                if k in chain:
                    note = "loop"
                    break
                if k not in at or at[k][2] != 2:
                    note = "broken link"
                    break
                if at[k][4] != now[1] or at[k][5] != len(chain):
                    note = note or "back link differs"
                chain.append(k)
                now = at[k]
            out[volume, head] = (chain, note or ("count differs" if at[head][5] != len(chain) - 1 else ""))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_chains_equal_following(spark, seed):
    rng, rows = random.Random(seed), []
    for volume in range(3):
        ids, files = rng.sample(range(1, 500), 150), []
        while ids:
            files.append([ids.pop() for _ in range(min(len(ids), rng.choice([1, 2, 5, 40])))])
        for f in files:
            for n, i in enumerate(f):
                rows.append([volume, i, 1 if n == 0 else 2, f[n + 1] if n + 1 < len(f) else 0, f[n - 1] if n else 0, len(f) - 1 if n == 0 else n])
        own = [r for r in rows if r[0] == volume]
        for r in rng.sample(own, 12) if seed else []:
            r[3] = rng.choice([rng.choice(own)[1], 9999, r[1], 0])  # into other files, astray, onto itself
        for r in rng.sample(own, 4):
            r[rng.choice([4, 5])] += 1
    got = chains.index_chains(spark.createDataFrame([tuple(r) for r in rows], SLOT).repartition(3)).collect()
    assert {(r["volume"], r["head"]): (list(r["clusters"]), r["note"]) for r in got} == followed(rows)


def test_no_slots(spark):
    assert chains.index_chains(spark.createDataFrame([], SLOT)).collect() == []


def test_the_true_base_wins_by_time(spark):
    """Slots ten seconds apart; at a base one slot off everything is ten seconds early."""
    heads = [(v, i, 1000 + 10 * i, 1009 + 10 * i, 0) for v in range(2) for i in range(40)]
    marks = [(v, 77 + v + 100 * i, 1001 + 10 * i, 1009 + 10 * i) for v in range(2) for i in range(40) if i % 4]
    df = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names.split()))
    got = chains.data_base(df(heads, "volume idx start_s end_s vol_start"), df(marks, "volume offset first_s last_s"), 100).orderBy("volume").collect()
    assert [(r["volume"], r["base"], r["found"], r["error_s"]) for r in got] == [(0, 77, 30, 0.5), (1, 78, 30, 0.5)]
    assert chains.data_base(df(heads, "volume idx start_s end_s vol_start"), df([], "volume offset first_s last_s"), 100).collect() == []


def test_short_loops_take_few_rounds(spark):
    """Ways into circles are as long as they are, however many slots the volume has."""
    links = spark.createDataFrame([(1, 10 * f + k, 10 * f + (k + 1 if k < 6 else 3)) for f in range(200) for k in range(7)], "volume long, a long, b long")
    levels, circling = chains._doubled(links)
    assert circling and len(levels) <= 5
    assert sorted(r["b"] for r in levels[-1].select("b").distinct().collect()) == [10 * f + k for f in range(200) for k in range(3, 7)]
    levels, circling = chains._doubled(links.where("a % 10 < 6"))
    assert not circling and len(levels) == 3


def test_bases_by_blocks_equal_a_plain_count(spark, monkeypatch):
    """Slots with holes and repeats, marks off the grid, before the volume and without a last second, over blocks of three slots."""
    monkeypatch.setattr(chains, "BLOCK", 3)
    rng = random.Random(3)
    heads = [(v, i, 1000 + 7 * i + rng.randrange(3), 1006 + 7 * i, 20) for v in (1, 2) for i in range(-2, 60) if rng.random() < 0.8 for _ in range(rng.choice([1, 1, 2]))] + [(3, 1, None, 5, 0)]
    marks = [(v, 50 + v + 10 * i + rng.choice([0, 0, 0, 10, 30, 3]), 1000 + 7 * i + rng.randrange(4), rng.choice([None, 1006 + 7 * i, 1008 + 7 * i])) for v in (1, 2) for i in range(60)] + [(1, -500, 1001, 1002), (1, 50, None, 1002)]
    want = []
    for v in (1, 2):
        own, votes = [h for h in heads if h[0] == v], {}
        meets = lambda h, m: m[2] is not None and h[2] - 2 <= m[2] <= h[3] + 2
        for h, m in ((h, m) for h in own for m in marks if m[0] == v):
            base = m[1] - 10 * h[1]
            if meets(h, m) and -1 <= m[2] - h[2] <= 12 and base >= 20:
                votes[base] = votes.get(base, 0) + 1
        top = sorted(votes, key=lambda b: (-votes[b], b))[:8]
        scores = []
        for base in {b + 10 * k for b in top for k in range(-3, 4) if b + 10 * k >= 20}:
            hit = [(h, m) for h in own for m in marks if m[0] == v and m[1] == base + 10 * h[1] and meets(h, m)]
            off = [abs(m[2] - h[2]) + abs(m[3] - h[3]) for h, m in hit if m[3] is not None]
            if hit:
                scores.append((sum(off) / (2 * len(hit)) if off else None, -votes.get(base, 0), base, len(hit)))
        fit = sorted((s for s in scores if s[3] >= 0.8 * max(x[3] for x in scores)), key=lambda s: (s[0] is not None, s[0] or 0, s[1], s[2]))
        want.append((v, fit[0][2], -fit[0][1], fit[0][3], fit[0][0], fit[1][0] if len(fit) > 1 else None))
    df = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names.split())).repartition(3)
    got = chains.data_base(df(heads, "volume idx start_s end_s vol_start"), df(marks, "volume offset first_s last_s"), 10)
    assert sorted(map(tuple, got.collect())) == want
