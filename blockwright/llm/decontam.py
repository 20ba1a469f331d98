"""Benchmark decontamination by latent semantic retrieval.

Every text is cut into pieces at least as long as the longest item of a block; two neighbouring pieces are a passage,
so that a copy of any item stands whole in one of them. Pieces are TF-IDF vectors over the items' terms (other words
have no weight against any item), and a passage is the sum of its two. One pass sums document frequencies and the sketch C W of C = A'A
for a random W, which partial sums of partitions give; the driver turns the sketch into singular vectors of A
(randomised Nystroem decomposition), where A holds the pieces and, with ITEMS times their weight in all, the items. A second
pass projects every passage and searches all items by cosine alone; candidates are then checked word by word: longest
common subsequence, the same over distinctive words, and the item's answer part. The benchmark is a query set: items
of like length make blocks of ``BLOCK``, each with a latent space of its own, and ``SCAN`` blocks share both passes: what
the driver gathers and sends, a row of ``BLOCK + EXTRA`` numbers for each term of a block, is bounded by them.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_runs, tidy

#: Items of a block, dimensions of its latent space beyond one for each item, seed of the random sketch, blocks of a scan.
BLOCK, EXTRA, SEED, SCAN = 32, 16, 5, 128
#: Words that more than this share of a block's items, and more than two, have are no terms and not distinctive, unless an item has no others.
USUAL = 0.05
#: Least cosine of a candidate, and weight of the items among the passages.
COSINE, ITEMS = 0.25, 4.0
#: Least shares of an item's words and of its distinctive words, in order, within a passage; and so many at least, or all.
WORDS, DISTINCTIVE, LEAST_WORDS, LEAST_DISTINCTIVE = 0.45, 0.4, 8, 5
#: Below this share of its words a part of the item's answer must be there too; from the second on the answer counts as found.
SURE, TRACE, ANSWER = 0.7, 0.34, 0.8
EDGE = ".,;:!?\"'()[]{}<>*#$%&|+-_=/\\~`^@"
RUN_BYTES = 4 << 20


def word_lists(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words of each text, in lower case and without marks at their ends: (how many, all of them)."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.utf8_lower(texts)))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return counts, pc.ascii_trim(lists.flatten(), characters=EDGE)


def common_subsequence(masks: dict[str, int], n: int, words) -> int:
    """Length of the longest common subsequence of an item of n words (masks: where each word stands) and words; bit-parallel."""
    free = (1 << n) - 1
    full = free
    for w in words:
        m = masks.get(w)
        if m:
            u = free & m
            free = ((free + u) | (free - u)) & full
    return n - free.bit_count()


class Item:
    """An item's words with the masks that the checks need."""

    def __init__(self, words: list[str], terms: set[str]):
        def masks(ws):
            out: dict[str, int] = {}
            for k, w in enumerate(ws):
                out[w] = out.get(w, 0) | 1 << k
            return out

        self.n = len(words)
        rare = [w for w in words if w in terms]
        answer = words[-max(3, self.n // 4) :]
        self.words, self.rare, self.answer = (masks(words), self.n), (masks(rare), len(rare)), (masks(answer), len(answer))
        self.least = max(int(np.ceil(WORDS * self.n)), min(self.n, LEAST_WORDS))
        self.least_rare = max(int(np.ceil(DISTINCTIVE * len(rare))), min(len(rare), LEAST_DISTINCTIVE))

    def check(self, words: list[str]) -> tuple[float, bool] | None:
        """(share of the item's words, answer found) of the best stretch of a passage, or None if nothing holds."""
        here = set(words)
        if sum(m.bit_count() for w, m in self.rare[0].items() if w in here) < self.least_rare:
            return None
        span = self.n + self.n // 2 + 2
        best = None
        for a in range(0, max(1, len(words) - span // 2), max(1, self.n // 4)):
            part = words[a : a + span]
            if common_subsequence(*self.rare, part) < self.least_rare:
                continue
            held = common_subsequence(*self.words, part)
            if held < self.least:
                continue
            answer = common_subsequence(*self.answer, part) / self.answer[1]
            found = (held / self.n, answer >= ANSWER)
            if (found[0] >= SURE or answer >= TRACE) and (best is None or found > best):
                best = found
        return best


class Block:
    """A block of items: its terms, and the length of passages."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        self.ids = [i for i, _ in rows]
        seen: dict[str, int] = {}
        for _, x in rows:
            for w in set(x):
                seen[w] = seen.get(w, 0) + 1
        usual = {w for w, k in seen.items() if k > max(2, USUAL * len(rows))}
        own = [[w for w in x if w not in usual] or x for _, x in rows]
        self.terms = sorted({w for x in own for w in x})
        self.items = [Item(x, set(o)) for (_, x), o in zip(rows, own)]
        at = {w: k for k, w in enumerate(self.terms)}
        self.of = [sorted({at[w] for w in x}) for x in own]
        self.step = max(16, *(len(x) for _, x in rows))
        self.sketch = np.random.default_rng(SEED).standard_normal((len(self.terms), min(len(rows) + EXTRA, len(self.terms)))).astype(np.float32)

    def pieces(self, counts: np.ndarray, where: np.ndarray, codes: np.ndarray):
        """(terms of each piece, distinct and sorted by piece; where each piece's begin; pieces; their texts; first piece of each text). Words ``where`` are the terms ``codes``."""
        ends = np.cumsum(counts)
        many = np.maximum(1, -(-counts // self.step))
        base = np.cumsum(many) - many
        own = np.diff(np.searchsorted(where, ends), prepend=0)  # how many of these words each text has
        keys = (np.repeat(base, own) + (where - np.repeat(ends - counts, own)) // self.step) << 32 | codes
        keys.sort()
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
        piece = keys >> 32
        starts = np.flatnonzero(np.diff(piece, prepend=-1))
        return keys & 0xFFFFFFFF, starts, piece[starts], np.searchsorted(base, piece[starts], side="right") - 1, base

    def sums(self, counts: np.ndarray, where: np.ndarray, codes: np.ndarray):
        """(terms, in how many pieces each stands, their part of C W)."""
        term, starts, *_ = self.pieces(counts, where, codes)
        made = np.add.reduceat(self.sketch[term], starts, axis=0)
        row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(term))))
        order = np.argsort(term, kind="stable")
        kinds, cuts, times = np.unique(term[order], return_index=True, return_counts=True)
        return kinds, times, np.add.reduceat(made[row[order]], cuts, axis=0)

    @staticmethod
    def passages(names: np.ndarray, texts: np.ndarray, base: np.ndarray):
        """(first, second, text, piece): of every passage with a term the rows of its pieces, -1 for one without any, its text, and which of the text's pieces it starts with."""
        row = np.arange(len(names))
        on = np.append((names[1:] == names[:-1] + 1) & (texts[1:] == texts[:-1]), False)
        lone = (names > base[texts]) & ~np.concatenate(([False], on[:-1]))  # the piece before has no term
        first, second = np.concatenate((row, np.full(int(lone.sum()), -1))), np.concatenate((np.where(on, row + 1, -1), row[lone]))
        text = np.concatenate((texts, texts[lone]))
        return first, second, text, np.concatenate((names, names[lone] - 1)) - base[text]


class Scan:
    """The blocks of a scan and which of their terms each word is."""

    def __init__(self, blocks: list[Block]):
        self.blocks = blocks
        self.words = sorted({w for b in blocks for w in b.terms})
        at = {w: k for k, w in enumerate(self.words)}
        slots = sorted((at[w], b, t) for b, block in enumerate(blocks) for t, w in enumerate(block.terms))
        word, self.block, self.term = (np.array(c, np.int64) for c in zip(*slots))
        self.many = np.bincount(word, minlength=len(self.words))
        self.first = np.cumsum(self.many) - self.many

    def found(self, words: pa.Array, values: pa.Array):
        """(block, places of its terms' words, which terms) for each block that some word belongs to."""
        codes = pc.fill_null(pc.index_in(words, value_set=values), -1).to_numpy(zero_copy_only=False)
        where = np.flatnonzero(codes >= 0)
        codes = codes[where]
        many = self.many[codes]
        slot = np.repeat(self.first[codes] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        where, block = np.repeat(where, many), self.block[slot]
        order = np.argsort(block, kind="stable")
        where, slot = where[order], slot[order]
        names, cuts = np.unique(block[order], return_index=True)
        for b, x, y in zip(names.tolist(), cuts, [*cuts[1:], len(slot)]):
            yield b, where[x:y], self.term[slot[x:y]]


class Space:
    """Weights of the terms, singular vectors of the passages, and the items in that space."""

    def __init__(self, block: Block, frequency: np.ndarray, sketch: np.ndarray, passages: int):
        self.weight = np.log((passages + 1) / (frequency + 1)) + 1
        omega = block.sketch / self.weight[:, None]
        whole = np.zeros((len(block.of), len(self.weight)))
        for k, t in enumerate(block.of):
            whole[k, t] = self.weight[t]
        # The items are passages too, and weigh more than all of the corpus.
        size = (whole**2).sum()
        more = ITEMS * max((frequency * self.weight**2).sum(), size) / size
        z = sketch * self.weight[:, None] + more * (whole.T @ (whole @ omega))
        # C is about Z (W'Z)^-1 Z'; a small shift keeps the factor stable.
        z = z + 1e-6 * max(1e-9, float(np.linalg.norm(z))) * omega
        core = omega.T @ z
        values, turn = np.linalg.eigh((core + core.T) / 2)
        keep = values > 1e-9 * max(values.max(initial=0), 1e-30)
        left, self.singular, _ = np.linalg.svd(z @ turn[:, keep] / np.sqrt(values[keep]), full_matrices=False)
        self.basis = (left * self.weight[:, None]).astype(np.float32)
        rows = whole @ left
        self.items = (rows / np.maximum(np.linalg.norm(rows, axis=1), 1e-9)[:, None]).astype(np.float32)
        # How many of an item's distinctive places a term fills, and how many of them the check wants.
        self.has = np.array([[item.rare[0].get(t, 0).bit_count() for item in block.items] for t in block.terms], np.int32)
        self.least = np.array([item.least_rare for item in block.items])

    def can_hold(self, term: np.ndarray, starts: np.ndarray, halves: list[np.ndarray], items: np.ndarray) -> np.ndarray:
        """Whether the terms of each passage, by its pieces' rows, fill as many of the item's distinctive places as the check wants."""
        held = np.zeros(len(items), np.int64)
        every = np.diff(np.append(starts, len(term)))
        for half in halves:
            there = np.flatnonzero(half >= 0)
            if not len(there):
                continue
            sizes = every[half[there]]
            first = np.cumsum(sizes) - sizes
            own = term[np.repeat(starts[half[there]] - first, sizes) + np.arange(int(sizes.sum()))]
            held[there] += np.add.reduceat(self.has[own, np.repeat(items[there], sizes)], first)
        return held >= self.least[items]


def _frequencies(docs: DataFrame, scan: Scan):
    """For each block (document frequencies, C W, number of passages), summed by term over partitions."""

    def run(batches):
        values = pa.array(scan.words, pa.string())
        count = [np.zeros(len(b.terms), np.int64) for b in scan.blocks]
        total = [np.zeros(b.sketch.shape, np.float32) for b in scan.blocks]
        passages = np.zeros(len(scan.blocks), np.int64)
        for batch in batches:
            for part in text_runs(batch, 0, RUN_BYTES):
                counts, words = word_lists(pc.fill_null(part.column(0), ""))
                for k, block in enumerate(scan.blocks):
                    passages[k] += int(np.maximum(1, -(-counts // block.step)).sum())
                for k, where, codes in scan.found(words, values):
                    kinds, times, z = scan.blocks[k].sums(counts, where, codes)
                    count[k][kinds] += times
                    total[k][kinds] += z
        for k in range(len(scan.blocks)):
            used = np.flatnonzero(count[k])
            z = pa.array(list(total[k][used]), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array(count[k][used]), z], names=["block", "term", "n", "z"])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([-1], pa.int32()), pa.array([passages[k]], pa.int64()), pa.array([[0.0]], pa.list_(pa.float32()))], names=["block", "term", "n", "z"])

    def added(group: pa.Table) -> pa.Table:
        z = group.column("z").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1).astype(np.float64).sum(axis=0)
        return pa.table({"block": group.column("block").slice(0, 1), "term": group.column("term").slice(0, 1), "n": pa.array([pc.sum(group.column("n")).as_py()]), "z": pa.array([z.astype(np.float32)], pa.list_(pa.float32()))})

    form = "block int, term int, n long, z array<float>"
    out = [[np.zeros(len(b.terms)), np.zeros(b.sketch.shape), 0] for b in scan.blocks]
    for r in docs.mapInArrow(tidy(run), form).groupBy("block", "term").applyInArrow(added, form).collect():  # one row per term of the scan's items
        if r["term"] < 0:
            out[r["block"]][2] = r["n"]
        else:
            out[r["block"]][0][r["term"]], out[r["block"]][1][r["term"]] = r["n"], r["z"]
    return out


def _search(docs: DataFrame, scan: Scan, spaces: list[Space], id_type: str) -> DataFrame:
    def run(batches):
        values = pa.array(scan.words, pa.string())
        for batch in batches:
            for part in text_runs(batch, 1, RUN_BYTES):
                counts, words = word_lists(pc.fill_null(part.column(1), ""))
                begins = np.cumsum(counts) - counts
                best: dict[tuple[int, int, int], tuple[float, bool, float]] = {}
                for b, where, codes in scan.found(words, values):
                    block, space = scan.blocks[b], spaces[b]
                    term, starts, names, texts, base = block.pieces(counts, where, codes)
                    made = np.concatenate([np.add.reduceat(space.basis[term[starts[at] : (starts[at + 2048] if at + 2048 < len(starts) else len(term))]], starts[at : at + 2048] - starts[at], axis=0) for at in range(0, len(starts), 2048)])
                    made = np.concatenate((made, np.zeros((1, made.shape[1]), made.dtype)))  # the last row is a piece without a term
                    first, second, text, piece = block.passages(names, texts, base)
                    for at in range(0, len(first), 4096):
                        halves = [first[at : at + 4096], second[at : at + 4096]]
                        whole = made[halves[0]] + made[halves[1]]
                        cosine = (whole @ space.items.T) / np.maximum(np.linalg.norm(whole, axis=1), 1e-9)[:, None]
                        near, which = np.nonzero(cosine >= COSINE)
                        # What the check is sure to refuse for want of the item's words is not cut out for it.
                        sure = space.can_hold(term, starts, [half[near] for half in halves], which)
                        told, passage = -1, []
                        for p, k in zip(near[sure].tolist(), which[sure].tolist()):
                            if p != told:
                                own = int(text[at + p])
                                a = int(begins[own]) + int(piece[at + p]) * block.step
                                told, passage = p, words.slice(a, min(2 * block.step, int(begins[own] + counts[own]) - a)).to_pylist()
                            if found := block.items[k].check(passage):
                                key = (own, b, k)
                                best[key] = max(best.get(key, (0.0, False, 0.0)), (*found, round(float(cosine[p, k]), 4)))
                rows = sorted(best)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array([r for r, *_ in rows], pa.int64())), pa.array([scan.blocks[b].ids[k] for _, b, k in rows], pa.int64()),
                        *(pa.array([best[r][c] for r in rows], t) for c, t in enumerate((pa.float64(), pa.bool_(), pa.float64()))),
                    ],
                    names=["id", "item_id", "overlap", "answer", "cosine"],
                )

    return docs.mapInArrow(tidy(run), f"id {id_type}, item_id long, overlap double, answer boolean, cosine double")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, overlap, answer, cosine): a row for each document and each benchmark item that it holds.

    An item is held where a stretch of half its length more than its own has enough of its words in order (see WORDS
    and DISTINCTIVE; all words of an item of up to five, so an item of one word is held wherever the word stands). Of
    several such stretches the best counts: the largest overlap, then the answer, then the largest cosine. Items and texts that are null or have no words match nothing; an empty
    benchmark or table gives no rows. Null ids stay null. Repeated rows of documents or items are found each for
    itself. Whole texts are searched; a text is held as words while it is.
    """
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = dict(chosen.dtypes)["id"]
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))
    rows = items.orderBy(F.length("t"), "i", "t").toLocalIterator()  # like lengths meet in a block
    out = None
    while part := [(r[0], r[1]) for r in islice(rows, BLOCK * SCAN)]:
        counts, words = word_lists(pa.array([t for _, t in part], pa.string()))
        ends = np.cumsum(counts)
        lists = [[w for w in words.slice(e - c, c).to_pylist() if w] for c, e in zip(counts.tolist(), ends.tolist())]
        kept = [(i, x) for (i, _), x in zip(part, lists) if x]
        if not kept:
            continue
        scan = Scan([Block(kept[k : k + BLOCK]) for k in range(0, len(kept), BLOCK)])
        spaces = [Space(b, *got) for b, got in zip(scan.blocks, _frequencies(chosen.select("text"), scan))]
        found = _search(chosen, scan, spaces, id_type)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"id {id_type}, item_id long, overlap double, answer boolean, cosine double")
    return out
