"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy, by backpropagation through time, on byte windows of a bounded sample of labelled
documents (``SAMPLE`` documents and ``WINDOWS`` windows of each). It then reads every byte of every text, in windows
run side by side, gives each position a distribution over the languages, and a document's distribution is the mean
over its positions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_runs, tidy

#: Bytes of a window, units of each direction, windows that step together.
WINDOW, UNITS, SIDE = 64, 8, 4096
#: Labelled documents of each language, at most, and windows taken from each.
SAMPLE, WINDOWS = 200, 4
#: Decimals of a score: products of batches of other sizes may differ in later ones.
DECIMALS = 4
EPOCHS, BATCH, RATE, SEED = 12, 128, 0.02, 7
#: One code after the bytes stands for what lies past a text's end.
CODES = 257
RUN_BYTES = 4 << 20
UND = "und"


def _squash(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights of both directions and of the read-out; a fixed size, whatever the corpus holds."""

    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        h = UNITS
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.languages = languages
        self.weights = {}
        for d in ("f", "b"):
            self.weights |= {f"x{d}": draw(CODES, 3 * h, scale=0.3), f"u{d}": draw(h, 3 * h, scale=h**-0.5), f"c{d}": np.zeros(3 * h, np.float32)}
        self.weights |= {"v": draw(2 * h, len(languages), scale=0.3), "o": np.zeros(len(languages), np.float32)}

    def _direction(self, codes: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        """States (T, N, h) of one direction over codes (T, N)."""
        h, w = UNITS, self.weights
        x, u, c = w[f"x{d}"], w[f"u{d}"], w[f"c{d}"]
        steps = range(len(codes)) if d == "f" else range(len(codes) - 1, -1, -1)
        state = np.zeros((codes.shape[1], h), np.float32)
        out = np.empty((*codes.shape, h), np.float32)
        for t in steps:
            given, own = x[codes[t]], state @ u
            own += c
            gates = given[:, : 2 * h] + own[:, : 2 * h]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            reset, keep = gates[:, :h], gates[:, h:]
            new = np.tanh(given[:, 2 * h :] + reset * own[:, 2 * h :])
            if trace is not None:
                trace.append((t, state, gates, own[:, 2 * h :].copy(), new))
            state = new + keep * (state - new)
            out[t] = state
        return out

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """(T, N, languages) probabilities of every position of windows (T, N)."""
        w = self.weights
        z = self._direction(codes, "f") @ w["v"][:UNITS] + self._direction(codes, "b") @ w["v"][UNITS:] + w["o"]
        z -= z.max(axis=2, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=2, keepdims=True)
        return z

    def gradients(self, codes: np.ndarray, target: np.ndarray, inside: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of the labelled positions, and its derivative by every weight."""
        h, w = UNITS, self.weights
        traces = {"f": [], "b": []}
        states = {d: self._direction(codes, d, traces[d]) for d in "fb"}
        z = states["f"] @ w["v"][:h] + states["b"] @ w["v"][h:] + w["o"]
        z -= z.max(axis=2, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=2, keepdims=True)
        n = np.arange(codes.shape[1])
        weight = inside / max(1, inside.sum())
        loss = float(-(np.log(p[:, n, target] + 1e-9) * weight).sum())
        dz = p
        dz[:, n, target] -= 1
        dz *= weight[:, :, None]
        grads = {"o": dz.sum((0, 1)), "v": np.concatenate([np.einsum("tnh,tnk->hk", states[d], dz, optimize=True) for d in "fb"])}
        for d, part in (("f", w["v"][:h]), ("b", w["v"][h:])):
            u = w[f"u{d}"]
            gx, gu, gc = np.zeros_like(w[f"x{d}"]), np.zeros_like(u), np.zeros_like(w[f"c{d}"])
            back = dz @ part.T
            carry = np.zeros_like(back[0])
            for t, state, gates, inner, new in reversed(traces[d]):
                total = back[t] + carry
                reset, keep = gates[:, :h], gates[:, h:]
                dnew = total * (1 - keep) * (1 - new * new)
                dkeep = total * (state - new) * keep * (1 - keep)
                dreset = dnew * inner * reset * (1 - reset)
                dgiven = np.concatenate((dreset, dkeep, dnew), axis=1)
                down = np.concatenate((dreset, dkeep, dnew * reset), axis=1)
                np.add.at(gx, codes[t], dgiven)
                gu += state.T @ down
                gc += down.sum(0)
                carry = total * keep + down @ u.T
            grads |= {f"x{d}": gx, f"u{d}": gu, f"c{d}": gc}
        return loss, grads

    def train(self, codes: np.ndarray, target: np.ndarray, inside: np.ndarray) -> None:
        """Adam over shuffled batches of windows (T, N)."""
        rng = np.random.default_rng(SEED + 1)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(codes.shape[1])
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                _, grads = self.gradients(codes[:, own], target[own], inside[:, own])
                step += 1
                rate = RATE * (0.5 ** (epoch / 4))
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def documents(self, texts: pa.Array) -> np.ndarray:
        """(documents, languages): the mean over all positions of each text; empty texts have zeros."""
        raw = texts.cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] else np.zeros(0, np.uint8)
        sizes = np.diff(offsets)
        many = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(sizes)), many)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        starts = offsets[:-1][owner] + within * WINDOW
        ends = offsets[1:][owner]
        sums = np.zeros((len(sizes), len(self.languages)))
        for at in range(0, len(starts), SIDE):
            spots = starts[at : at + SIDE] + np.arange(WINDOW)[:, None]
            inside = spots < ends[at : at + SIDE]
            codes = np.where(inside, data[np.minimum(spots, len(data) - 1)], CODES - 1)
            p = (self.positions(codes) * inside[:, :, None]).sum(axis=0)
            np.add.at(sums, owner[at : at + SIDE], p)
        return sums / np.maximum(sizes, 1)[:, None]


def held_out(id_col: str = "doc_id"):
    """True for the documents that nothing is learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network trained on windows of the labelled documents with the smallest id hashes of each language; None without any."""
    keys = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    counts = cut(keys.groupBy("lang").agg(F.count("*").alias("n")))  # a row for each language
    languages = sorted(r["lang"] for r in counts.collect())
    if not languages:
        return None
    # The smallest hashes of each language: few rows are near enough to nought to be ranked at all.
    share = (F.xxhash64("id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).alias("share")
    near = keys.join(F.broadcast(counts), "lang").select("id", "lang", "n", share).where(F.col("share") * F.col("n") < 8 * SAMPLE).select("id", "lang", "share").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("share", "id"))
    few = F.broadcast(cut(near.withColumn("rank", rank).where(F.col("rank") <= SAMPLE).select("id").distinct()))  # SAMPLE ids of each language at most

    def run(batches):
        for batch in batches:
            langs, windows = [], []
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py().encode()
                rng = np.random.default_rng(len(text))
                for at in sorted({int(x) for x in rng.integers(0, max(1, len(text) - WINDOW + 1), WINDOWS)}):
                    langs.append(batch.column(1)[i].as_py()), windows.append(text[at : at + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(windows, pa.binary())], names=["lang", "bytes"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null and text <> ''")
    rows = texts.join(few, "id", "left_semi").mapInArrow(tidy(run), "lang string, bytes binary").collect()
    rows = sorted((r["lang"], bytes(r["bytes"])) for r in rows)
    if not rows:
        return None
    codes = np.full((WINDOW, len(rows)), CODES - 1, np.int64)
    for i, (_, window) in enumerate(rows):
        codes[: len(window), i] = np.frombuffer(window, np.uint8)
    network = Network(sorted({lang for lang, _ in rows}))
    network.train(codes, np.array([network.languages.index(lang) for lang, _ in rows]), (codes < CODES - 1).astype(np.float32))
    return network


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", network: Network | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, held_out, lang_pred, score, and ``keep``) for every document.

    The prediction uses the text alone. A null text, an empty one or one without a letter is ``und`` with score 0, as
    is every text when no document is labelled. Ties go to the language that comes first in the alphabet. Null ids and
    repeated rows stay; an empty table gives no rows. A very long text is read in windows like any other.
    """
    network = network or learn(docs, id_col, text_col, lang_col)
    chosen = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    schema = f"id {dict(chosen.dtypes)['id']}, held_out boolean, lang_pred string, score double" + "".join(f", keep_{c} {dict(docs.dtypes)[c]}" for c in keep)

    def run(batches):
        for batch in batches:
            for part in text_runs(batch, 2, RUN_BYTES):
                texts = pc.fill_null(part.column(2), "")
                letters = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
                langs, scores = np.full(len(texts), UND, object), np.zeros(len(texts))
                if network is not None:
                    p = np.round(network.documents(texts), DECIMALS)
                    best = p.argmax(axis=1)
                    langs = np.where(letters, np.array(network.languages, object)[best], UND)
                    scores = np.where(letters, np.round(np.clip(p[np.arange(len(p)), best], 0, 1), DECIMALS), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(langs.tolist(), pa.string()), pa.array(scores), *(part.column(3 + j) for j in range(len(keep)))],
                    names=["id", "held_out", "lang_pred", "score", *(f"keep_{c}" for c in keep)],
                )

    return chosen.mapInArrow(tidy(run), schema)
