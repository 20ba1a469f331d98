import hashlib
import random

import numpy as np
from helpers import HARD, documents

from blockwright.llm import bpe, queries

PATH = queries.tokenizer_path()


def expected(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    ids = tok.encode(text or "", add_special_tokens=False).ids
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tok.decode(ids, skip_special_tokens=False).encode())


def test_equals_library(spark):
    rng = random.Random(4)
    parts = ["<|endoftext|>", " ", "\n", "\t ", "a", "B'll", "é", "日本", "🙂", "12", "½", "\u00a0", "\u3000", "!", "#<|", "\x1c", "\x85"]
    texts = [*HARD, "<|endoftext|>", "a<|endoftext|><|endoftext|> b", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(200)), "word " * 30_000]
    got = {r["id"]: tuple(r)[1:] for r in bpe.encode_decode(documents(spark, texts), PATH).collect()}
    assert got == {k: expected(t) for k, t in enumerate(texts)}


def test_repeated_and_null_ids_and_empty_table(spark):
    df = documents(spark, [(1, "one"), (1, "two"), (None, "three")])
    rows = bpe.encode_decode(df, PATH, digests=False).collect()
    assert sorted((str(r["id"]), r["decoded"]) for r in rows) == [("1", "one"), ("1", "two"), ("None", "three")]
    assert bpe.encode_decode(df.limit(0), PATH).count() == 0


def test_reads_files_without_a_copy(spark, tmp_path):
    documents(spark, ["some text", "more"]).write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    assert bpe._repeatable(df) and not bpe._repeatable(df.repartition(2))
    assert {r["n_tokens"] for r in bpe.encode_decode(df, PATH).collect()} == {expected("some text")[0], expected("more")[0]}
