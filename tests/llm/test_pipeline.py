"""The pipeline against plain Python over the same documents, stage by stage."""

import corpus_pipeline
import numpy as np
from blockwright.llm import queries
from helpers import documents

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.dtypes, {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k + 1 == len(corpus_pipeline.STAGES):
            break
        assert docs.dtypes == columns, name
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        gone = set(before) - set(after)
        if name == "language id":
            assert not any(any(c.isalpha() for c in before[i] or "") for i in gone)
        if name == "simhash near-dedup":
            texts = [before[i] for i in sorted(before)]
            assert len(set(texts)) >= len(after) and len({t for t in after.values()}) == len(after)
        if name == "benchmark decontamination":
            held = {i for i, t in before.items() if any(x[:80] in t for x in items)}
            assert gone == held
        if name == "secret scans":
            assert not gone and all(after[i] == before[i] or "[SECRET]" in after[i] for i in before)
        before = after
    assert docs.count() == len(before) and set(docs.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_entry_has_all_queries():
    import __spark_entry__ as e

    names = e.queries()
    assert {"pipeline", *queries.QUERIES} <= set(names) and len([n for n in names if n.startswith("op")]) == 13
    assert np.all([n in names for n in e.oracle_sql()])


def copies_of(texts):
    """Texts by id that a smaller id's copy stands for: equal words, or five-word shingles with a similarity of 0.8."""
    sets = {}
    for i, text in texts.items():
        words = (text or "").encode().lower().split()
        if words:
            sets[i] = (words, {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))})
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i][1], sets[j][1]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i for i in ids if root(i) != i}


def test_near_dedup_drops_what_brute_force_does(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[1][1](spark, docs, DATA).select("doc_id").collect()}
    assert set(texts) - kept == copies_of(texts)


def test_stages_take_empty_tables_and_clashing_columns(spark):
    rows = ["one plain text", None, "", "one plain text", (None, "no id here"), (0, "one plain text"), "x" * 3000]
    for name, stage in corpus_pipeline.STAGES:
        df = documents(spark, rows)
        out = stage(spark, df, DATA)
        assert stage(spark, df.limit(0), DATA).count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == df.dtypes, name
        assert out.count() <= len(rows) and out.where("doc_id is null").count() == 1, name
