import hashlib
import random
import re

from helpers import HARD, documents

from blockwright.llm import secret_scan


def brute(text):
    spans = []
    for k, (kind, pattern, group, least) in enumerate((
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24),
    )):
        flags = re.I | re.A if kind == "assign" else 0
        spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "", flags) if len(m[group]) >= least]
    return ",".join(s for *_, s in sorted(spans))


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(8)
    bits = ["Token", "=", " ", ":", '"', "password", "aPi_Key", "ſecret", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "é", "abc", "token=token: abcdef", "\n"]
    texts = [*HARD, *("".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(400))]
    rows = secret_scan.scan(documents(spark, texts)).collect()
    for r in rows:
        assert r["base_sha256"] == hashlib.sha256(brute(texts[r["id"]]).encode()).hexdigest(), texts[r["id"]]
    assert {r["id"]: r["redacted"] for r in rows}[0] is None


def test_grammar_finds_bare_formats_and_leaves_words(spark):
    rng = random.Random(2)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(18))
    texts = [f"plain words and password={key()} here" for _ in range(60)] + [f"bare {key()} stands here", "a verylongwordwithoutanydigit 12345678901234567890 x"]
    rows = {r["id"]: r for r in secret_scan.scan(documents(spark, texts)).collect()}
    assert rows[60]["spans"] == "format_assign:5:23" and "[SECRET]" in rows[60]["redacted"] and rows[61]["spans"] == ""
    assert all(r["n_assign"] == 1 for k, r in rows.items() if k < 60)


def test_automaton_merges_and_scores():
    values = ["ab" * n for n in range(6, 12)] * 10
    a = secret_scan.Automaton(values)
    assert a.score("ababababababab") > -2 and a.score("+++") == float("-inf")


def test_empty_table(spark):
    assert secret_scan.scan(documents(spark, ["x"]).limit(0)).count() == 0


def test_planted_credentials_are_found_in_the_table(spark):
    """Bare values of the formats that the table's labelled credentials have, in every fifth text: recall and precision."""
    rng = random.Random(23)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    planted, texts = {}, []
    for i, text in rows:
        if text and i % 5 == 0:
            value = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((18, 20, 23))))
            at = text.find(" ", rng.randrange(len(text))) % (len(text) + 1)
            text = f"{text[:at]} {value} {text[at:]}"
            planted[i] = f"{at + 1}:{at + 1 + len(value)}"
        texts.append((i, text))
    got = {r["id"]: [s.split(":", 1)[1] for s in r["spans"].split(",") if s.startswith("format_")] for r in secret_scan.scan(documents(spark, texts)).collect()}
    found = sum(planted[i] in got[i] for i in planted)
    others = sum(len(v) for v in got.values()) - found
    print(len(planted), found, others)
    assert found >= 0.9 * len(planted) and others <= 0.05 * found


def plain_score(automaton, value):
    """The likelihood of a value, step by step."""
    return automaton.score(value) * (len(value) + 1)


def test_tokens_in_step_score_as_one_by_one(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(secret_scan, "LONG", 40)
    rng = random.Random(24)
    automaton = secret_scan.Automaton(["".join(rng.choice("0123456789abcdefXYZ") for _ in range(rng.randint(4, 60))) for _ in range(200)])
    texts = [" ".join("".join(rng.choice("0189abcdefXYZgq+=.") for _ in range(rng.randint(1, 70))) for _ in range(20)) for _ in range(20)] + ["", "é..é", "..a..", "=" * 100]
    for piece in (1 << 20, 64):
        monkeypatch.setattr(secret_scan, "PIECE", piece)
        raw = pa.array(texts).cast(pa.large_binary())
        offsets, data = np.frombuffer(raw.buffers()[1], np.int64), np.frombuffer(raw.buffers()[2], np.uint8)
        found = []
        for bounds in secret_scan._gathered(secret_scan._pieces(data, offsets)):
            classes, a, b, owner = secret_scan.tokens(data, bounds)
            scores = secret_scan.likelihoods(automaton.tables(), classes, a, b)
            for x, y, k, s in zip(a.tolist(), b.tolist(), owner.tolist(), scores.tolist()):
                value = data[bounds[0][0] + x : bounds[0][0] + y].tobytes().decode()
                found.append((k, value))
                want = plain_score(automaton, value)
                assert s == want or abs(s - want) < 1e-6, value
        want = [(k, m[0].strip("+/_.=-")) for k, t in enumerate(texts) for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", t)]
        assert found == [x for x in want if x[1]]


def test_many_secrets_take_linear_time(spark):
    text = " ".join(f"token=abc{k}def password: xyz{k}abc" for k in range(30000))
    row = secret_scan.scan(documents(spark, [text, None])).orderBy("id").collect()[0]
    assert row["n_assign"] == 60000 and "abc7def" not in row["redacted"]
