"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Statistics are computed once for every whole text and kept as a small table. Labelled rows are mapped to random
cosine features that approximate a Gaussian kernel; each partition sums its part of the normal equations, and the
sums meet row by row of the matrix. The ridge scores are calibrated by isotonic regression over a histogram of
all labelled scores. What reaches the driver has a fixed size whatever the corpus holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_runs, tidy

#: Random features, kernel width (in standard deviations), ridge, bins of the calibration, seed.
FEATURES, WIDTH, RIDGE, BINS, SEED = 160, 3.0, 1.0, 512, 11
#: Groups that partial sums of the normal equations meet in first.
SALT = 32
#: From this score on a text is predicted to be good.
THRESHOLD = 0.7
RUN_BYTES = 4 << 20

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (32, 9, 11, 12, 13), "line": (10,), "stop": b".,;:", "shout": b"!?", "mark": b"#$%&*+/<=>@\\^_`{|}~-", "quote": b"\"'()[]", "high": range(128, 256),
}
_LOOKUP = {k: np.isin(np.arange(256), list(v)).astype(np.uint8) for k, v in _CLASSES.items()}
NAMES = (*(f"share_{k}" for k in _CLASSES), "log_bytes", "log_words", "word_bytes", "word_spread", "distinct", "log_lines", "distinct_lines", "line_bytes", "top_word", "marked_words", "shouted_words")


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each run of values."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(texts: pa.Array) -> np.ndarray:
    """(documents, statistics) of whole texts; empty texts have zeros but for what a logarithm of one adds."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    base = offsets[0]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[base : offsets[-1]] if raw.buffers()[2] else np.zeros(0, np.uint8)
    offsets = offsets - base
    size = np.diff(offsets)
    n = np.maximum(size, 1)
    out = [_sums(lookup[data], offsets) / n for lookup in _LOOKUP.values()]

    def parts(lists: pa.Array):
        count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        values = lists.flatten()
        return count, values, np.concatenate(([0], np.cumsum(count)))

    def distinct(count, values):
        """Distinct parts of each text, and how often its commonest one occurs."""
        codes = values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(count)), count)
        keys, times = np.unique(owner << 32 | codes, return_counts=True)
        most = np.zeros(len(count), np.int64)
        np.maximum.at(most, keys >> 32, times)
        return np.bincount(keys >> 32, minlength=len(count)), most

    words, values, at = parts(pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts)))
    length = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    many = np.maximum(words, 1)
    mean = _sums(length, at) / many
    spread = np.sqrt(np.maximum(_sums(length * length, at) / many - mean * mean, 0))
    kinds, most = distinct(words, values)
    lines, rows, _ = parts(pc.split_pattern(texts, "\n"))
    line_kinds, _ = distinct(lines, rows)
    marked = pc.match_substring_regex(values, r"[#$%&*|]|[!?]{2}").to_numpy(zero_copy_only=False)
    shouted = pc.match_substring_regex(values, r"^[A-Z]{3,}").to_numpy(zero_copy_only=False)
    out += [
        np.log1p(size), np.log1p(words), mean, spread, kinds / many, np.log1p(lines), line_kinds / np.maximum(lines, 1), np.log1p(size / np.maximum(lines, 1)), most / many,
        _sums(marked, at) / many, _sums(shouted, at) / many,
    ]
    return np.stack(out, axis=1)


class Model:
    """Scaling, projection, ridge weights and calibration; a fixed size."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.maximum(spread, 1e-6)
        self.turn = rng.standard_normal((len(mean), FEATURES)) / WIDTH / np.sqrt(len(mean) / 4)
        self.shift = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights, self.edges, self.levels = np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.concatenate((np.cos(z @ self.turn + self.shift), np.ones((len(x), 1))), axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        # Rounded, so that equal texts have equal scores wherever they stand in a batch.
        return np.round(np.clip(np.interp(self.raw(x), self.edges, self.levels), 0, 1), 9)


def isotonic(total: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Non-decreasing fit to good/total with weights total, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for n, g in zip(total, good):
        blocks.append([g, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), g / n) for g, n, k in blocks]) if blocks else np.zeros(0)


def held_out(id_col: str = "doc_id"):
    """True for the documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, x) with the statistics of every text; a null text counts as empty."""
    chosen = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in text_runs(batch, 2, RUN_BYTES):
                x = statistics(pc.fill_null(part.column(2), ""))
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), rows], names=["id", "held_out", "x"])

    return chosen.mapInArrow(tidy(run), f"id {dict(chosen.dtypes)['id']}, held_out boolean, x array<double>")


def _matrix(batch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model | None:
    """A model of the labelled rows that are not held out; None without any. Repeated labels of an id are averaged."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.avg(label_col).alias("y"))
    rows = cut(stats.where(~F.col("held_out")).join(known, F.col("id") == F.col("label_id")).select("x", "y"))
    sums = rows.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("spread")).orderBy("k").collect()
    if not sums:
        return None
    model = Model(np.array([r["mean"] for r in sums]), np.array([r["spread"] for r in sums]))

    def equations(batches):
        size = FEATURES + 1
        total = np.zeros((size, size + 1))
        for batch in batches:
            z, y = model.features(_matrix(batch, 0)), batch.column(1).to_numpy(zero_copy_only=False)
            total += z.T @ np.concatenate((z, y[:, None]), axis=1)
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % SALT
        yield pa.RecordBatch.from_arrays([pa.array([salt] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["salt", "k", "v"])

    def added(group: pa.Table) -> pa.Table:
        v = _matrix(group.combine_chunks().to_batches()[0], 2).sum(axis=0)
        return pa.table({"salt": pa.array([0], pa.int32()), "k": group.column("k").slice(0, 1), "v": pa.array([v.tolist()], pa.list_(pa.float64()))})

    form = "salt int, k int, v array<double>"
    met = rows.mapInArrow(tidy(equations), form).groupBy("salt", "k").applyInArrow(added, form).groupBy("k").applyInArrow(added, form)
    whole = np.array([r["v"] for r in sorted(met.collect(), key=lambda r: r["k"])])
    gram, right = whole[:, :-1], whole[:, -1]
    model.weights = np.linalg.solve(gram + RIDGE * np.eye(len(gram)), right)

    def histogram(batches):
        counts = np.zeros((BINS, 3))
        for batch in batches:
            raw, y = model.raw(_matrix(batch, 0)), batch.column(1).to_numpy(zero_copy_only=False)
            at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            for k, w in enumerate((None, y, raw)):
                counts[:, k] += np.bincount(at, weights=w, minlength=BINS)
        used = np.flatnonzero(counts[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(counts[used, k]) for k in range(3))], names=["bin", "n", "good", "raw"])

    bins = rows.mapInArrow(tidy(histogram), "bin int, n double, good double, raw double").groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("n", "good", "raw")]).orderBy("bin").collect()
    n, good, raw = (np.array([r[c] for r in bins]) for c in ("n", "good", "raw"))
    model.edges, model.levels = raw / n, isotonic(n, good)
    return model


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted) for every document.

    Scores come from the text's statistics alone; null and empty texts are scored like any other. Without labels
    every score is 0.5. Repeated rows stay, and equal texts have equal scores. Several labels of a document are averaged.
    Very long texts are measured whole. An empty table gives no rows. Other columns are not looked at, whatever their names.
    """
    stats = cut(document_statistics(docs, id_col, text_col))
    model = learn(stats, labels, id_col, label_col)

    def run(batches):
        for batch in batches:
            score = model.score(_matrix(batch, 2)) if model is not None and batch.num_rows else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    return stats.mapInArrow(tidy(run), f"id {dict(stats.dtypes)['id']}, held_out boolean, score double, predicted int")
