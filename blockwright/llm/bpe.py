"""Byte-level BPE encoding and decoding through a distinct-word table.

Texts are split into words in Spark by the tokenizer's own pattern. A block of documents becomes a head (which word
stands at which position) and its distinct words. The distinct-word table of the corpus is dealt into buckets by the
words' hashes: a bucket meets the distinct words of all blocks that fall into it, encodes each distinct word once,
and answers every block with the ids of its words. Blocks put the ids back by position and join them with the
id-to-piece table of the vocabulary, whose size the vocabulary bounds, to decode. What moves is each block's
distinct words, so a word that makes up a tenth of all text costs no more entries than there are blocks.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, runs, shared_path, text_or_empty, tidy

#: The byte-level pre-tokenizer's pattern, with Unicode white space spelled out (fixed values).
SPACE = r"\t-\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 6 << 20
#: Bytes of input for each bucket of the distinct-word table, and fewest buckets.
BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 32


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def special_tokens(path: str) -> list[str]:
    """Added tokens that the tokenizer finds in raw text, before the pattern splits it."""
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


@lru_cache(maxsize=2)
def id_to_piece(path: str) -> pa.Array:
    """The bytes of each id, by id. As many entries as the vocabulary has, whatever the corpus holds."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = set(special_tokens(path))
    vocab = _tokenizer(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        out[i] = t.encode() if t in special else bytes(byte_of[c] for c in t)
    return pa.array(out, pa.binary())


def split_words(text, specials: list[str]):
    """Column: the text's words in order; together they are the whole text."""
    plain = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    if not specials:
        return plain
    marked = "|".join("".join("\\" + c if c in r"\.[]{}()*+-?^$|<>" and c not in "<>" else c for c in s) for s in specials)
    # The runs between special tokens, and the tokens themselves, alternate.
    runs = F.transform(F.split(text, marked, -1), lambda run: F.regexp_extract_all(run, F.lit(PATTERN), F.lit(0)))
    found = F.transform(F.regexp_extract_all(text, F.lit(marked), F.lit(0)), lambda s: F.array(s))
    mixed = F.flatten(F.transform(F.arrays_zip(runs.alias("r"), found.alias("s")), lambda z: F.concat(z["r"], F.coalesce(z["s"], F.array().cast("array<string>")))))
    return F.when(text.rlike(marked), mixed).otherwise(plain)


def _pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers with their bytes in planes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _pack_words(words: pa.Array) -> bytes:
    import zstandard

    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False)
    body = np.array([len(words)], "<u4").tobytes() + sizes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() + b"".join(words.cast(pa.binary()).to_pylist())
    return zstandard.ZstdCompressor(level=3).compress(body)


def _unpack_words(packed: bytes) -> pa.Array:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw[:4], "<u4")[0])
    sizes = np.ascontiguousarray(np.frombuffer(raw[4 : 4 + 4 * n], np.uint8).reshape(4, -1).T).view("<u4").ravel()
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[4 + 4 * n :]))


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]


def _block_rows(buckets: int, heads: bool):
    """Rows (block, bucket, body) of blocks: their heads, at bucket -1, or their distinct words by bucket.

    Heads are the larger part and need no answer, so they are made apart and travel once. Each body opens with the
    digest of the block's word list, by which both parts prove that they come from the same block.
    """

    def rows(block: int, part: pa.RecordBatch) -> pa.RecordBatch:
        import pandas as pd

        words = part.column(1)
        coded = words.flatten().dictionary_encode()
        names = coded.dictionary
        codes = coded.indices.to_numpy(zero_copy_only=False)
        of = (pd.util.hash_array(np.array(names.to_pylist(), dtype=object), categorize=False) % buckets).astype(np.int64) if len(names) else np.zeros(0, np.int64)
        dealt = np.argsort(of, kind="stable")
        mark = hashlib.blake2b(b"\0".join(x.encode() for x in names.to_pylist()), digest_size=8).digest()
        if heads:
            # Positions hold ranks by frequency, which compress well; place says where a rank stands in the buckets' lists.
            often = np.argsort(-np.bincount(codes, minlength=len(names)), kind="stable")
            rank, place = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
            rank[often] = place[dealt] = np.arange(len(names))
            ids = part.column(0)
            head = [
                pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), np.packbits(ids.is_null().to_numpy(zero_copy_only=False)).tobytes(),
                _pack(pc.list_value_length(words).to_numpy(zero_copy_only=False)), _pack(rank[codes]), _pack(place[often]),
            ]
            out = [(-1, mark + b"".join(len(h).to_bytes(8, "little") + h for h in head))]
        else:
            cuts = np.flatnonzero(np.diff(of[dealt], prepend=-1))
            listed = names.take(pa.array(dealt))
            out = [(int(of[dealt[a]]), mark + _pack_words(listed.slice(a, b - a))) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(dealt)])]
        return pa.RecordBatch.from_arrays(
            [pa.array([block] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["block", "bucket", "body"]
        )

    def run(batches):
        from pyspark import TaskContext

        task, k, held, total = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for part in runs(batch, batch.column(2).to_numpy(), BLOCK_BYTES):
                held.append(part)
                total += pc.sum(part.column(2)).as_py()
                if total >= BLOCK_BYTES:
                    yield rows((task << 24) + k, _joined(held))
                    held, total, k = [], 0, k + 1
        if held:
            yield rows((task << 24) + k, _joined(held))

    return run


def _encode_bucket(path: str):
    """One bucket of the distinct-word table: each distinct word is encoded once, each block's list answered in its order."""

    def run(group: pa.Table) -> pa.Table:
        bodies = group.column("body").to_pylist()
        lists = [_unpack_words(x[8:]) for x in bodies]
        coded = pa.concat_arrays(lists).dictionary_encode()
        tok = _tokenizer(path)
        found = [e.ids for e in tok.encode_batch(coded.dictionary.to_pylist(), add_special_tokens=False)]
        ids = pa.array(found, pa.list_(pa.uint32()))
        out, at = [], 0
        for own, body in zip(lists, bodies):
            mine = ids.take(coded.indices.slice(at, len(own)))
            at += len(own)
            sizes = pc.list_value_length(mine).to_numpy(zero_copy_only=False)
            out.append(body[:8] + _pack(np.concatenate(([len(own)], sizes, mine.flatten().to_numpy(zero_copy_only=False)))))
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "body": pa.array(out, pa.binary())})

    return run


def _put_back(group: pa.Table):
    """(ids of a block's documents, their token ids as arrays)."""
    group = group.take(pa.array(np.argsort(group.column("bucket").to_numpy(), kind="stable"))).combine_chunks()
    bodies = group.column("body").to_pylist()
    if group.column("bucket")[0].as_py() != -1 or len({x[:8] for x in bodies}) > 1:
        raise RuntimeError("the input gave other rows when it was read again; write it as a table first")
    bodies = [x[8:] for x in bodies]
    head, at = [], 0
    while at < len(bodies[0]):
        size = int.from_bytes(bodies[0][at : at + 8], "little")
        head.append(bodies[0][at + 8 : at + 8 + size])
        at += 8 + size
    ids = np.frombuffer(head[0], "<i8")
    nulls = np.unpackbits(np.frombuffer(head[1], np.uint8))[: len(ids)].astype(bool)
    counts, ranks, place = (_unpack(x) for x in head[2:])
    sizes, flat = [], []
    for body in bodies[1:]:
        raw = _unpack(body)
        sizes.append(raw[1 : 1 + raw[0]])
        flat.append(raw[1 + raw[0] :])
    sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.uint32)
    flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
    words = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))
    ends = np.cumsum(counts.astype(np.int64))

    def documents():
        begin = 0
        for end in ends.tolist():
            chosen = place[ranks[begin:end]]
            begin = end
            yield words.take(pa.array(chosen)).flatten().to_numpy(zero_copy_only=False).astype("<u4")

    return pa.array(ids, pa.int64(), mask=nulls), documents


def _decode(ids: np.ndarray, pieces: pa.Array) -> str:
    """As the library: the pieces of all ids one after another; bytes that are no UTF-8 become replacement characters."""
    chosen = pieces.take(pa.array(ids))
    if not len(chosen):
        return ""
    first, last = (int.from_bytes(chosen.buffers()[1][4 * i : 4 * i + 4], "little") for i in (0, len(chosen)))
    return chosen.buffers()[2][first:last].to_pybytes().decode("utf-8", "replace")


SUMMARY = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _summary(path: str):
    def run(group: pa.Table) -> pa.Table:
        names, documents = _put_back(group)
        pieces = id_to_piece(path)
        count, coded, decoded = [], [], []
        for ids in documents():
            count.append(len(ids))
            coded.append(hashlib.sha256(ids.tobytes()).hexdigest())
            decoded.append(hashlib.sha256(_decode(ids, pieces).encode()).hexdigest())
        give_back()
        return pa.table({"id": names, "n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(coded, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())})

    return run


def _whole(path: str):
    def run(group: pa.Table) -> pa.Table:
        names, documents = _put_back(group)
        pieces = id_to_piece(path)
        ids = [x.astype(np.int32) for x in documents()]
        return pa.table({"id": names, "token_ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array([_decode(x, pieces) for x in ids], pa.string())})

    return run


def _repeatable(df: DataFrame) -> bool:
    """Whether two scans give the same rows in the same order: files, projected or filtered, and nothing else."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" or plan.nodeName().startswith("Relation")


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    With ``digests`` the rows are (id, n_tokens, ids_sha256, decoded_sha256), else (id, token_ids, decoded).
    A null text is empty: no tokens, digests of nothing. Repeated rows and equal ids give a row each; a null id is
    kept; an empty table gives no rows. A very long text is a block of its own. Special tokens of the tokenizer that
    stand in a text get their ids, as in the library. Files are read twice: a session whose executors come and go
    should fix ``spark.sql.files.minPartitionNum``, so that both scans cut them alike; if not, the job ends with an error.
    """
    spark = docs.sparkSession
    specials = special_tokens(tokenizer_path)
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    if not _repeatable(chosen):
        path = shared_path(spark, "bpe-docs")
        chosen.write.parquet(path)
        chosen = spark.read.parquet(path)
    split = chosen.select("id", split_words(F.col("text"), specials).alias("words"), F.octet_length("text").cast("long").alias("size"))
    # What a bucket holds stays alike: there are more of them in a larger input, by the size that its files report.
    size = int(chosen._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    form = "block long, bucket long, body binary"
    lists = split.mapInArrow(tidy(_block_rows(buckets, heads=False)), form)
    answered = split.mapInArrow(tidy(_block_rows(buckets, heads=True)), form).unionByName(lists.groupBy("bucket").applyInArrow(_encode_bucket(tokenizer_path), form))
    if digests:
        return answered.groupBy("block").applyInArrow(_summary(tokenizer_path), SUMMARY)
    return answered.groupBy("block").applyInArrow(_whole(tokenizer_path), "id long, token_ids array<int>, decoded string")
