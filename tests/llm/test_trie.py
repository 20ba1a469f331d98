"""The trie against a dictionary of tuples, over hard rows, and the query against its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import oracle
import pytest

from blockwright.llm import queries, trie


def by_hand(rows):
    """Nodes as a dictionary of tuples of turns; every sum by walking all descendants."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(turns.get(c - c % 100, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)

    def under(k):
        todo, seen = [k], []
        while todo:
            seen.append(todo.pop())
            todo += kids[seen[-1]]
        return seen

    out = []
    for k, m in members.items():
        low = under(k)
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(k))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in low if x)
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), sum(not kids[x] for x in low), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, convs, most, words):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(most)):
            rows.append((c if c < convs // 2 else 1000 + c * 7, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice([None, "", *(f"w{k}ß🙂" for k in range(words))])))
    return rows


CASES = {
    "bushy": made(1, 150, 5, 2), "deep": made(2, 60, 14, 1), "wide": made(3, 80, 3, 40),
    "copies": [(c, t, "user", f"same {t}") for c in range(300) for t in range(6)],
    "ties": [(7, 1, "a", "x"), (7, 1, "a", "x"), (7, 1, "b", "y"), (7, None, None, None), (7, None, "z", "q"), (None, 1, "a", "x"), (100, 0, "a", "long " * 5000), (101, 0, "a", "b"), (-5, 3, "a", "b")],
    "one": [(3, 0, "a", "b")],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_trie_equals_dictionary(spark, name):
    rows = CASES[name]
    df = spark.createDataFrame([(*r, 1, "k", 0) for r in rows], "conv_id long, turn long, role string, text string, depth int, k0 string, a int")
    assert sorted(map(tuple, trie.prefix_trie(df).collect()), key=str) == by_hand(rows)


def test_stretches_of_all_ordered_steps(spark, monkeypatch):
    monkeypatch.setattr(trie, "BITS", 2)
    monkeypatch.setattr(trie, "BLOCK", 4)
    rows = made(5, 40, 23, 1) + [(c, t, "u", "s" if t < 20 else f"e{c % 3}") for c in range(5000, 5030) for t in range(31)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, trie.prefix_trie(df).collect()), key=str) == by_hand(rows)


def test_empty_table(spark):
    assert trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_light_edges_are_few(spark):
    """A caterpillar of 64 conversations: one path holds the spine, so one round is enough."""
    rows = [(c * 100, t, "u", "s" if t < c else f"end{c}") for c in range(64) for t in range(c + 1)]
    nodes = trie._on_paths(trie.prefixes(trie.rebuilt(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    assert nodes.agg({"level": "max"}).first()[0] <= 6


def test_query_equals_sql(spark):
    got = oracle.rows(queries.QUERIES["op12_trie"](spark, oracle.DATA).toPandas())
    assert got == oracle.rows(oracle.connection().execute(queries.ORACLE_SQL["op12_trie"]).df())
