"""SimHash fingerprints of word shingles and their exact Hamming join through a Gray-order hierarchical index.

Fingerprints are computed from whole texts in Arrow batches. Equal fingerprints meet once (pre-aggregated), so a
group of exact copies of any size costs one index entry. Two fingerprints within ``radius`` bits agree on one of
``radius + 1`` bit fields, so each is filed under every field; a field's entries are sorted by Gray rank, cut into
leaves whose members share a masked bit pattern, and leaves are gathered into upper nodes with the pattern that
their members share. A search walks pairs of nodes from the top and drops a pair of groups as soon as the
differences that their shared patterns prove exceed the radius. Fields with too many entries are divided again by
the bits that the field does not cover, until every group is small. A group returns a spanning forest of its
links, never all pairs, and distributed connected components join the forests.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, packed, text_runs, tidy
from .components import connected_components

#: Longest run of rows handled at once, in bytes of text.
RUN_BYTES = 4 << 20
#: Entries of one leaf, and children of one upper node.
LEAF, FAN = 32, 8
#: A field's group with more entries is divided by the bits that are still free.
GROUP = 4096
#: Most divisions, after which free bits run short; a group of distinct fingerprints has then at most 2**16 entries.
DEPTH = 4
#: Bytes of a long text that are cut into words at once, and hashes whose bits are counted at once.
PIECE, VOTED = 1 << 20, 200_000
BLANK = re.compile(rb"[ \t-\r]")


class Votes:
    """For each of many texts, how many of its shingles' hashes set each bit; hashes are counted many texts at once."""

    def __init__(self, texts: int):
        self.sums, self.n = np.zeros((texts, 64), np.int32), np.zeros(texts, np.int64)
        self.hashes: list[np.ndarray] = []
        self.owners: list[int] = []
        self.held = 0

    def add(self, text: int, hashes: np.ndarray) -> None:
        self.hashes.append(hashes), self.owners.append(text)
        self.held += len(hashes)
        if self.held >= VOTED:
            self.settle()

    def settle(self) -> None:
        if not self.hashes:
            return
        sizes = np.array([len(h) for h in self.hashes])
        bits = np.unpackbits(np.concatenate(self.hashes).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        np.add.at(self.sums, self.owners, np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int32))
        np.add.at(self.n, self.owners, sizes)
        self.hashes, self.owners, self.held = [], [], 0

    def result(self) -> np.ndarray:
        """The fingerprints: a bit is set if it is in over half the hashes."""
        self.settle()
        return np.packbits(self.sums * 2 > self.n[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def shingle_hashes(text: str, width: int, digest=None):
    """Arrays of the hashes of a text's shingles, in order, a piece of the text at a time; ``digest`` takes in its words."""
    from xxhash import xxh64_intdigest

    data, at, words, total = text.encode(), 0, [], 0
    while at < len(data):
        blank = BLANK.search(data, at + PIECE)
        end = blank.start() if blank else len(data)
        fresh = data[at:end].lower().split()
        at = end
        if digest is not None and fresh:
            digest.update((b" " if total else b"") + b" ".join(fresh))
        total += len(fresh)
        words += fresh
        if len(words) >= width:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            yield np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64)
            words = words[len(words) - width + 1 :]
    if 0 < total < width:
        yield np.array([xxh64_intdigest(b" ".join(words), 42)], np.uint64)


def _fingerprints(texts: list[str], width: int) -> np.ndarray:
    """One 64-bit fingerprint for each text; without words it is zero."""
    votes = Votes(len(texts))
    for i, text in enumerate(texts):
        for hashes in shingle_hashes(text, width):
            votes.add(i, hashes)
    return votes.result()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): fp holds the fingerprint's 64 bits as a signed long. Null texts and texts without words have 0."""

    def run(batches):
        for batch in batches:
            for part in text_runs(batch, 1, RUN_BYTES):
                fp = _fingerprints([t or "" for t in part.column(1).to_pylist()], width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(tidy(run), "id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code word in the binary-reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _find(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Flat labels (smallest index of each component so far) after joining a[i] with b[i]."""
    while True:
        x, y = parent[a], parent[b]
        keep = x != y
        if not keep.any():
            return parent
        a, b, x, y = a[keep], b[keep], x[keep], y[keep]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        parent = _find(parent)


def _levels(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mask, value) of the nodes of each level, leaves first: the bits that all members share, and what they are."""
    cuts = np.arange(0, len(x), LEAF)
    both, some = np.bitwise_and.reduceat(x, cuts), np.bitwise_or.reduceat(x, cuts)
    levels = [(~(both ^ some), both)]
    while len(both) > 1:
        cuts = np.arange(0, len(both), FAN)
        both, some = np.bitwise_and.reduceat(both, cuts), np.bitwise_or.reduceat(some, cuts)
        levels.append((~(both ^ some), both))
    return levels


def linked_groups(x: np.ndarray, radius: int, chunk: int = 2048) -> np.ndarray:
    """Smallest index reachable from each of the distinct fingerprints x, which stand in Gray order."""
    n, parent = len(x), np.arange(len(x))
    levels = _levels(x)
    pairs = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while pairs:
        level, a, b = pairs.pop()
        mask, value = levels[level]
        near = np.bitwise_count((value[a] ^ value[b]) & mask[a] & mask[b]) <= radius
        a, b = a[near], b[near]
        if not len(a):
            continue
        if len(a) > chunk:
            pairs += [(level, a[i : i + chunk], b[i : i + chunk]) for i in range(0, len(a), chunk)]
            continue
        if level:
            size = len(levels[level - 1][0])
            i = (a[:, None] * FAN + np.arange(FAN)).repeat(FAN, axis=1).ravel()
            j = np.tile(b[:, None] * FAN + np.arange(FAN), (1, FAN)).ravel()
            ok = (i < size) & (j < size) & (i <= j)
            pairs.append((level - 1, i[ok], j[ok]))
            continue
        i = (a[:, None] * LEAF + np.arange(LEAF)).repeat(LEAF, axis=1).ravel()
        j = np.tile(b[:, None] * LEAF + np.arange(LEAF), (1, LEAF)).ravel()
        ok = (i < n) & (j < n) & (i < j)
        i, j = i[ok], j[ok]
        ok = parent[i] != parent[j]
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(x[i] ^ x[j]) <= radius
        parent = _unite(parent, i[ok], j[ok])
    return parent


def _near_neighbours(x: np.ndarray, group: np.ndarray, sizes: np.ndarray, radius: int):
    """Links inside groups of at most a leaf's size, all groups at once: compare each row with those that follow it."""
    for d in range(1, int(sizes.max(initial=1))):
        same = group[d:] == group[:-d]
        if not same.any():
            return
        ok = same & (np.bitwise_count(x[d:] ^ x[:-d]) <= radius)
        i = np.flatnonzero(ok)
        yield i, i + d


def _forest(radius: int):
    """Arrow batches of (key, fp), a key's rows standing together, to edges of a spanning forest."""

    def solve(keys: np.ndarray, x: np.ndarray):
        order = np.lexsort((gray_rank(x), keys))
        keys, x = keys[order], x[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        group = np.repeat(np.arange(len(starts)), sizes)
        small = np.repeat(sizes <= LEAF, sizes)
        src, dst = [], []
        if small.any():
            xs, gs = x[small], group[small]
            parent = np.arange(len(xs))
            for i, j in _near_neighbours(xs, gs, sizes[sizes <= LEAF], radius):
                parent = _unite(parent, i, j)
            hung = np.flatnonzero(parent != np.arange(len(xs)))
            src.append(xs[hung]), dst.append(xs[parent[hung]])
        for k in np.flatnonzero(sizes > LEAF):
            own = x[starts[k] : starts[k] + sizes[k]]
            parent = linked_groups(own, radius)
            hung = np.flatnonzero(parent != np.arange(len(own)))
            src.append(own[hung]), dst.append(own[parent[hung]])
        a = np.concatenate(src) if src else np.zeros(0, np.uint64)
        b = np.concatenate(dst) if dst else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])

    def run(batches):
        keys: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            keys.append(k), rows.append(f)
            held += len(k)
            if held >= 200_000 and keys[0][0] != k[-1]:  # the last key may go on in the next batch
                allk, allf = np.concatenate(keys), np.concatenate(rows)
                last = int(np.argmax(allk == allk[-1]))
                yield solve(allk[:last], allf[:last])
                keys, rows, held = [allk[last:]], [allf[last:]], len(allk) - last
        if held:
            yield solve(np.concatenate(keys), np.concatenate(rows))

    return run


def _mask(positions: list[int]):
    """The long with these bits set."""
    value = sum(1 << int(b) for b in positions)
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def hamming_edges(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(src, dst) edges that connect exactly the distinct fingerprints of column fp that chains of links connect.

    Every link of ``radius`` bits or fewer is found: cut the free bits into ``radius + 1`` fields, and two such
    fingerprints agree on one of them. Groups above ``GROUP`` entries are divided again, in the same way, by the
    bits that are still free. Which groups those are is counted, not guessed, and stays a table.
    """
    rows = fps.select("fp", F.lit("").alias("path"), F.lit(0).cast("long").alias("key"))
    free = {"": list(range(64))}
    out, depth = [], 0
    while True:
        fields = {p: [f.tolist() for f in np.array_split(np.array(bits), radius + 1)] for p, bits in free.items()}
        entries = None
        for p, fs in fields.items():
            made = F.array(*[F.struct(F.lit(f"{p}{k}").alias("path"), F.col("fp").bitwiseAND(_mask(f)).alias("v")) for k, f in enumerate(fs)])
            entries = made if entries is None else F.when(F.col("path") == p, made).otherwise(entries)
        keyed = rows.select("fp", "key", F.explode(entries).alias("e")).select(
            "fp", F.col("e.path").alias("path"), F.xxhash64("key", "e.path", "e.v").alias("key")
        )
        if depth == DEPTH:
            out.append(keyed.select("key", "fp"))
            break
        hot = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("key"))
        if hot.isEmpty():
            out.append(keyed.select("key", "fp"))
            break
        out.append(keyed.join(hot, "key", "left_anti").select("key", "fp"))
        rows = cut(keyed.join(hot, "key", "left_semi").select("fp", "path", "key"))
        free = {f"{p}{k}": [b for b in free[p] if b not in f] for p, fs in fields.items() for k, f in enumerate(fs)}
        depth += 1
    edges = None
    for part in out:
        one = part.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_forest(radius)), "src long, dst long")
        edges = one if edges is None else edges.unionByName(one)
    return edges.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp, component): texts whose fingerprints chains of links of ``radius`` bits or fewer connect.

    The component is the smallest id that can be reached, the row's own included. A null id keeps its row and is
    never a component unless all of its component's ids are null. Null and empty texts have fingerprint 0, which
    links like any other. Repeated rows stay repeated; equal fingerprints are one node, so ties cost nothing and no
    order of rows matters. Very long texts are hashed whole, in parts. An empty table gives no rows. Other columns are not
    looked at, whatever their names.
    """
    prints = cut(fingerprints(docs, id_col, text_col, width))
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("least")))
    comps = connected_components(hamming_edges(distinct, radius))
    roots = distinct.join(comps, distinct.fp == comps.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("component"))
    classes = roots.join(least, "root").select(F.col("fp").alias("class_fp"), "component")
    return prints.join(classes, prints.fp == classes.class_fp).select("id", "fp", "component")


#: Near copies: lists of texts that share a shingle give all their candidate pairs at once up to this size.
PAIRED = 32
#: Shingles of PAIRED texts or more stand last in every text's order; so many of them at most. Speed alone hangs on it.
COMMON = 100_000
#: Shingles counted at once; one that is met once only in so many is not passed on.
COUNTED = 4_000_000
#: Least bits of a text's sketch, the parities of its shingles' hashes by their lowest bits; it has two for a shingle.
SKETCH = 1024
#: Differing bits of fingerprints that are linked before shingles are looked at.
RADIUS = 3
#: Rows of one list that are dealt into one chunk.
BLOCK = 4096
#: Rows of a few ids that may be broadcast; more are joined by a shuffle.
BROADCAST = 1 << 18
#: Pairs that a text's set meets at once.
PAIRS = 4096


def shingle_set(text: str, width: int, digest=None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    parts = list(shingle_hashes(text, width, digest))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _prefix_size(n: int, similarity: float) -> int:
    """So many first shingles of n, in one order for all texts, share one with every text of this similarity."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1


def common_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """Sorted hashes of the shingles of most texts.

    All shingles of all texts are counted. One that a stretch of COUNTED shingles holds once only is not passed on
    from there, so what is missed stands in fewer texts than there are stretches.
    """

    def run(batches):
        held, total = [], 0

        def told():
            k, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(k[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["k", "n"])

        for batch in batches:
            for part in text_runs(batch, 1, RUN_BYTES):
                for text in part.column(1).to_pylist():
                    own = shingle_set(text or "", width)
                    held.append(own)
                    total += len(own)
                    if total >= COUNTED:
                        yield told()
                        held, total = [], 0
        if held:
            yield told()

    counts = texts.mapInArrow(tidy(run), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= PAIRED)
    return np.sort(np.array([r["k"] for r in counts.orderBy(F.desc("n"), "k").limit(COMMON).collect()], np.int64).view(np.uint64))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of distinct hashes by their lowest bits, as words; a power of two of them."""
    size = SKETCH
    while size < 2 * len(hashes):
        size *= 2
    odd = (np.bincount((hashes % np.uint64(size)).astype(np.int64), minlength=size) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8")


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """The sketch of the same hashes with ``size`` words, which is no larger."""
    return np.bitwise_xor.reduce(words.reshape(-1, size), axis=0)


def _sketches(column, size: int = SKETCH // 64) -> np.ndarray:
    """Sketches of a column, all folded to the least size."""
    return np.stack([folded(np.frombuffer(b, np.uint64), size) for b in column.to_pylist()]) if len(column) else np.zeros((0, size), np.uint64)


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values stand in the sorted array known."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _text_facts(texts: DataFrame, width: int, similarity: float, common: np.ndarray) -> DataFrame:
    """(id, words, fp, n, light, prefix, bits) of the texts that have words.

    The digest of the words, the fingerprint of the shingles, how many there are, the first of them (of which the
    first ``light`` are not common) and their sketch.
    """
    from hashlib import blake2b

    def run(batches):
        for batch in batches:
            for part in text_runs(batch, 1, RUN_BYTES):
                at, keys, sets, lights, firsts, bits = [], [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    digest = blake2b(digest_size=16)
                    h = shingle_set(text or "", width, digest)
                    if not len(h):
                        continue
                    often = _within(h, common)
                    first = np.concatenate((h[~often], h[often]))[: _prefix_size(len(h), similarity)]
                    at.append(i), sets.append(h), firsts.append(first.view(np.int64)), keys.append(digest.digest())
                    lights.append(min(len(first), int((~often).sum())))
                    bits.append(sketch(h).tobytes())
                ends = np.concatenate(([0], np.cumsum([len(f) for f in firsts]))).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts) if firsts else np.zeros(0, np.int64)))
                votes = Votes(len(sets))
                for i, h in enumerate(sets):
                    for k in range(0, len(h), VOTED):
                        votes.add(i, h[k : k + VOTED])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.binary()), pa.array(votes.result().view(np.int64)), pa.array([len(h) for h in sets], pa.int64()),
                        pa.array(lights, pa.int64()), prefix, pa.array(bits, pa.binary()),
                    ],
                    names=["id", "words", "fp", "n", "light", "prefix", "bits"],
                )

    return texts.mapInArrow(tidy(run), "id long, words binary, fp long, n long, light long, prefix array<long>, bits binary")


def _most_apart(n, m, similarity: float):
    """So many shingles at most are in one only of two sets of n and m of this similarity; their sketches differ in no more bits."""
    return (1 - similarity) / (1 + similarity) * (n + m) + 1e-6


def _can_reach(n, m, i, j, similarity: float):
    """Whether sets of n and m that share their i-th and j-th shingle, and none before, may be similar enough."""
    return 1 + np.minimum(n - i - 1, m - j - 1) >= similarity / (1 + similarity) * (n + m) - 1e-6


def _short_lists(similarity: float):
    """Rows (key, id, spot, comp), a rare key's together, to (key, src, dst, n, pos, comp); spot holds n, pos and whether the key is rare.

    Pairs of different components from the lists of up to PAIRED texts; rows of longer lists as they are, with a null
    dst. No list is held: once it is longer its rows are passed on as they come.
    """
    names = ["key", "src", "dst", "n", "pos", "comp"]

    def passed(rows: np.ndarray) -> pa.RecordBatch:
        key, i, n, pos, comp = (pa.array(np.ascontiguousarray(c)) for c in rows.T)
        return pa.RecordBatch.from_arrays([key, i, pa.nulls(len(rows), pa.int64()), n, pos, comp], names=names)

    def paired(rows: np.ndarray, sizes: np.ndarray, begin: np.ndarray) -> pa.RecordBatch:
        left = np.repeat(begin + sizes, sizes)
        live = np.flatnonzero(np.repeat(sizes > 1, sizes))
        found = [np.zeros((0, 2), np.int64)]
        for d in range(1, int(sizes.max(initial=1))):
            live = live[live + d < left[live]]
            x, y = rows[live], rows[live + d]
            ok = _can_reach(x[:, 2], y[:, 2], x[:, 3], y[:, 3], similarity) & (x[:, 4] != y[:, 4])
            found.append(np.stack([np.maximum(x[ok, 1], y[ok, 1]), np.minimum(x[ok, 1], y[ok, 1])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        none = pa.nulls(len(pairs), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])), none, none, none], names=names)

    def solve(rows: np.ndarray):
        begin = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0])))
        sizes = np.diff(np.append(begin, len(rows)))
        short = np.repeat(sizes <= PAIRED, sizes)
        if not short.all():
            yield passed(rows[~short])
            rows, sizes = rows[short], sizes[sizes <= PAIRED]
        if len(rows):
            yield paired(rows, sizes, np.cumsum(sizes) - sizes)

    def run(batches):
        held: list[np.ndarray] = []
        many, long = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids, spot = (batch.column(k).to_numpy() for k in range(3))
            comp = pc.coalesce(batch.column(3), batch.column(1)).to_numpy()
            rows, rare = np.stack((key, ids, spot >> 32, (spot & 0xFFFFFFFF) >> 1, comp), axis=1), (spot & 1).astype(bool)
            if not rare.all():
                yield passed(rows[~rare])
                rows = rows[rare]
            if long is not None and len(rows):  # the list that filled the last rows goes on
                own = rows[:, 0] == long
                if own.any():
                    yield passed(rows[own])
                    rows = rows[~own]
                if len(rows):
                    long = None
            held.append(rows)
            many += len(rows)
            if many >= 100_000:
                whole = np.concatenate(held)
                last = int(np.argmax(whole[:, 0] == whole[-1, 0]))
                if last:
                    yield from solve(whole[:last])
                rest = whole[last:]
                if len(rest) > PAIRED:
                    long = rest[0, 0]
                    yield passed(rest)
                    rest = rest[:0]
                held, many = [rest], len(rest)
        if many:
            yield from solve(np.concatenate(held))

    return run


def gray_order(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of rows of words by group, then by the Gray rank of all their bits."""
    odd = (np.bitwise_count(x) & 1).astype(np.int64)
    turned = (np.cumsum(odd, axis=1) - odd) & 1
    rank = np.where(turned == 1, ~gray_rank(x), gray_rank(x))
    return np.lexsort((*rank.T[::-1], group))


def close_pairs(x: np.ndarray, n: np.ndarray, comp: np.ndarray, similarity: float, suits, chunk: int = 64):
    """(i, j, differing bits) of the rows of sketches x, in Gray order, that may be similar enough and are of two components.

    A search walks pairs of nodes of the hierarchical index from the top. A pair of nodes is dropped when the bits
    that their members share already differ too often, when no sizes fit, or when all are of one component.
    ``suits(i, j)`` says which pairs of rows are wanted.
    """
    levels, ranges = _levels(x), []
    at = [n, n, comp, comp]
    for k in range(len(levels)):
        cuts = np.arange(0, len(at[0]), FAN if k else LEAF)
        at = [f.reduceat(v, cuts) for f, v in zip((np.minimum, np.maximum) * 2, at)]
        ranges.append(at)
    todo = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, a, b = todo.pop()
        mask, value = levels[level]
        low, high, first, last = ranges[level]
        ok = (similarity * low[b] <= high[a] + 1e-6) & (similarity * low[a] <= high[b] + 1e-6)
        ok &= ~((first[a] == last[a]) & (first[b] == last[b]) & (first[a] == first[b]))
        a, b = a[ok], b[ok]
        ok = np.bitwise_count((value[a] ^ value[b]) & mask[a] & mask[b]).sum(axis=1, dtype=np.int64) <= _most_apart(high[a], high[b], similarity)
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        if len(a) > chunk:
            todo += [(level, a[i : i + chunk], b[i : i + chunk]) for i in range(0, len(a), chunk)]
            continue
        wide, size = (FAN, len(levels[level - 1][0])) if level else (LEAF, len(x))
        i = (a[:, None] * wide + np.arange(wide)).repeat(wide, axis=1).ravel()
        j = np.tile(b[:, None] * wide + np.arange(wide), (1, wide)).ravel()
        if level:
            ok = (i < size) & (j < size) & (i <= j)
            todo.append((level - 1, i[ok], j[ok]))
            continue
        ok = (i < size) & (j < size) & (i < j)
        i, j = i[ok], j[ok]
        ok = (comp[i] != comp[j]) & suits(i, j)
        i, j = i[ok], j[ok]
        apart = np.bitwise_count(x[i] ^ x[j]).sum(axis=1, dtype=np.int64)
        ok = apart <= _most_apart(n[i], n[j], similarity)
        yield i[ok], j[ok], apart[ok]


def _long_lists(similarity: float, nearest: bool):
    """Rows (key, a, b, chunk, id, n, pos, comp, bits), a block's together, to (src, dst) pairs of its chunks a and b.

    Either of each text its nearest one, or all that may be similar enough and are not of one component.
    """

    def solve(a: int, b: int, cols: list[np.ndarray]):
        n, bits = cols[2], cols[5]
        order = gray_order(bits, np.floor(np.log(np.maximum(n, 1)) / -np.log(similarity)).astype(np.int64) if similarity < 1 else n)
        chunk, ids, n, pos, comp, bits = (c[order] for c in cols)

        def suits(i, j):
            return (ids[i] != ids[j]) & (np.minimum(chunk[i], chunk[j]) == a) & (np.maximum(chunk[i], chunk[j]) == b) & _can_reach(n[i], n[j], pos[i], pos[j], similarity)

        best, mate = np.full(len(ids), SKETCH + 1), np.zeros(len(ids), np.int64)
        for i, j, apart in close_pairs(bits, n, comp, similarity, suits):
            if not nearest:
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(ids[i], ids[j])), pa.array(np.minimum(ids[i], ids[j]))], names=["src", "dst"])
                continue
            x, y, apart = np.concatenate((i, j)), np.concatenate((j, i)), np.tile(apart, 2)
            order = np.lexsort((ids[y], apart, x))
            x, y, apart = x[order], y[order], apart[order]
            one = np.concatenate(([True], x[1:] != x[:-1])) if len(x) else np.zeros(0, bool)
            x, y, apart = x[one], y[one], apart[one]
            less = apart < best[x]
            best[x[less]], mate[x[less]] = apart[less], y[less]
        if nearest and (i := np.flatnonzero(best <= SKETCH)).size:
            s, t = ids[i], ids[mate[i]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(s, t)), pa.array(np.minimum(s, t))], names=["src", "dst"])

    def solve_all(table: pa.Table):
        cols = [table.column(k).to_numpy() for k in range(8)]
        bits = _sketches(table.column(8))
        new = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
        cuts = np.flatnonzero(np.concatenate(([True], new, [True])))
        for s, e in zip(cuts[:-1], cuts[1:]):
            yield from solve(cols[1][s], cols[2][s], [*(c[s:e] for c in cols[3:]), bits[s:e]])

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= 50_000:
                whole = pa.Table.from_batches(held)
                same = np.ones(len(whole), bool)
                for k in range(3):
                    c = whole.column(k).to_numpy()
                    same &= c == c[-1]
                last = int(np.argmax(same))
                if last:
                    yield from solve_all(whole.slice(0, last))
                held, rows = whole.slice(last).to_batches(), len(whole) - last
        if rows:
            yield from solve_all(pa.Table.from_batches(held))

    return run


def _blocks(entries: DataFrame) -> DataFrame:
    """(key, a, b, chunk, id, n, pos): lists above BLOCK texts are dealt into chunks, and every two chunks meet in a block; lists of one component alone are not needed.

    What is known of a list is one short row, broadcast where there are few enough lists, so a list with many entries
    is no single task; beyond that adaptive execution may split it.
    """
    sizes = entries.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    known = _small(sizes.select("key", F.ceil(F.col("size") / BLOCK).cast("long").alias("chunks")))
    dealt = entries.join(known, "key").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    others = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    return others.select("key", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "chunk", "id", "n", "pos")


def _counted(rows: DataFrame) -> tuple[DataFrame, int]:
    """A table of a few numbers a row, kept, and how many rows it has."""
    rows = cut(rows)
    n = rows.count()
    return packed(rows, n), n


def _small(rows: DataFrame) -> DataFrame:
    """Rows of a few numbers each, marked for a broadcast if they are counted to be few enough."""
    rows, n = _counted(rows)
    return F.broadcast(rows) if n <= BROADCAST else rows


def _joined(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of nodes with comp, the component of their id under the links."""
    comps = _small(connected_components(links))
    return nodes.join(comps, F.col("id") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "id")).drop("node", "component")


def _places(pairs: DataFrame) -> DataFrame:
    """(k, w, at, part, head): where the rows of pairs (src, dst, src_words, dst_words) meet.

    A pair meets at its src. What that text brings goes there once for each PAIRS pairs, the other texts follow it.
    """
    parts = pairs.groupBy(F.col("src").alias("at")).agg(F.ceil(F.count("*") / PAIRS).cast("long").alias("parts"))
    led = pairs.join(parts, F.col("src") == F.col("at")).withColumn("part", F.pmod(F.xxhash64("dst"), F.col("parts")))
    both = F.array(*[F.struct(F.col(c).alias("k"), F.col(f"{c}_words").alias("w"), F.lit(c == "src").alias("head")) for c in ("src", "dst")])
    return _small(led.select("at", "part", F.explode(both).alias("p")).select("p.k", "p.w", "at", "part", "p.head").distinct())


def _meet(rows: DataFrame, places: DataFrame, fits) -> DataFrame:
    """The pairs (src, dst, src_words, dst_words) of rows (id, words, n, s) that meet and fit each other."""
    same = (F.col("id") == F.col("k")) & F.coalesce(F.col("words") == F.col("w"), F.lit(True))
    sent = rows.join(places, same).select("at", "part", "head", "id", "words", "n", "s")

    def run(batches):
        at = head = None
        for batch in batches:
            found = [[], [], [], []]
            for group, part, first, k, w, n, s in zip(*(batch.column(c).to_pylist() for c in range(7))):
                own = (n, np.frombuffer(s, np.uint64), w)
                if first:
                    at, head = (group, part), own
                elif at == (group, part) and fits(head[0], head[1], own[0], own[1]):
                    for column, value in zip(found, (group, k, head[2], w)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["src", "dst", "src_words", "dst_words"])

    met = sent.repartition("at", "part").sortWithinPartitions("at", "part", F.desc("head"))
    return met.mapInArrow(tidy(run), "src long, dst long, src_words binary, dst_words binary")


def similar_pairs(texts: DataFrame, sketches: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (src, dst) of ids whose sets of shingles have this Jaccard similarity or more, kept.

    The sketches (id, words, n, bits) drop most of the others first; what is left is counted exactly over the sets of
    the texts with these ids and digests of words.
    """
    from hashlib import blake2b

    def may_be(m, a, n, b):
        size = min(len(a), len(b))
        return min(m, n) >= similarity * max(m, n) - 1e-6 and np.bitwise_count(folded(a, size) ^ folded(b, size)).sum() <= _most_apart(m, n, similarity)

    def close(m, a, n, b):
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both >= similarity * (m + n - both)

    def sets(batches):
        for batch in batches:
            for part in text_runs(batch, 1, RUN_BYTES):
                keys, made = [], []
                for text in part.column(1).to_pylist():
                    digest = blake2b(digest_size=16)
                    made.append(shingle_set(text, width, digest)), keys.append(digest.digest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array([len(s) for s in made], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())], names=["id", "words", "n", "s"])

    some, _ = _counted(pairs.select("src", "dst").distinct())
    none = F.lit(None).cast("binary")
    rows = sketches.select("id", "words", "n", F.col("bits").alias("s"))
    near, _ = _counted(_meet(rows, _places(some.select("src", "dst", none.alias("src_words"), none.alias("dst_words"))), may_be))
    places = _places(near)
    touched = _small(places.select(F.col("k").alias("t")).distinct())
    mine = texts.join(touched, texts.id == F.col("t"), "left_semi").where("text is not null").dropDuplicates(["id", "text"])
    exact = _meet(mine.mapInArrow(tidy(sets), "id long, words binary, n long, s binary"), places, close)
    return _counted(exact.select("src", "dst").distinct())[0]


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component) of the texts that have a copy: equal words, or shingles of ``width`` words with this Jaccard similarity.

    Every such pair counts, wherever the texts differ, and none else. Texts with equal words meet first, then those
    whose fingerprints the Gray-order index links. What is still apart is compared by shared shingles: two such texts
    share one of their first shingles in one order for all texts (prefix filter), so a list of the texts for each
    first shingle holds every pair. Short lists give all pairs; long ones are searched through the Gray-order index
    over sketches, blocks of two chunks at a time, first for each text's nearest one and then for all that is not yet
    connected. Every pair found in any of these ways is counted exactly before it links.

    The component is the smallest id. Null ids and texts without words are left out; an empty table gives no rows.
    Repeated rows count once. Of different texts with one id that with the smallest digest of words counts. Long texts
    are read in pieces.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    facts = cut(_text_facts(texts, width, similarity, common_shingles(texts, width)))
    one = facts.groupBy("id").agg(F.min("words").alias("words"))
    classes = cut(one.groupBy("words").agg(F.min("id").alias("first"), F.count("*").alias("copies")))
    firsts = classes.select(F.col("words").alias("w"), "first")
    chosen = cut(facts.join(firsts, (F.col("id") == F.col("first")) & (F.col("words") == F.col("w"))).drop("w", "first").dropDuplicates(["id", "words"]))
    sketches = chosen.select("id", "words", "n", "bits")

    # What the fingerprints link.
    prints, _ = _counted(chosen.groupBy("fp").agg(F.min("id").alias("at")))
    edges, _ = _counted(hamming_edges(prints.select("fp"), RADIUS))
    at = [prints.select(F.col("fp").alias(f"{k}_fp"), F.col("at").alias(k)) for k in ("x", "y")]
    across = edges.join(at[0], F.col("src") == F.col("x_fp")).join(at[1], F.col("dst") == F.col("y_fp")).select("x", "y")
    equal = chosen.select("fp", "id").join(prints, "fp").where("id <> at").select(F.col("id").alias("x"), F.col("at").alias("y"))
    told = across.unionByName(equal).select(F.greatest("x", "y").alias("src"), F.least("x", "y").alias("dst"))
    links = similar_pairs(texts, sketches, told, width, similarity)

    # What shared shingles link beyond that.
    posted = _joined(links, chosen.select("id", "n", "light", "prefix")).select("id", "n", "light", "comp", F.posexplode("prefix").alias("pos", "key"))
    rare = (F.col("pos") < F.col("light")).cast("long")
    spot = F.shiftleft(F.col("n"), 32).bitwiseOR(F.shiftleft(F.col("pos").cast("long"), 1)).bitwiseOR(rare)
    posted = posted.select("key", "id", spot.alias("spot"), F.when(F.col("comp") != F.col("id"), F.col("comp")).alias("comp"))
    dealt = posted.repartition(F.when(F.col("spot").bitwiseAND(F.lit(1)) == 1, F.col("key")).otherwise(F.xxhash64("id", "key"))).sortWithinPartitions("key")
    made = cut(dealt.mapInArrow(tidy(_short_lists(similarity)), "key long, src long, dst long, n long, pos long, comp long"))
    links = links.unionByName(similar_pairs(texts, sketches, made.where("dst is not null"), width, similarity))
    entries, many = _counted(made.where("dst is null").select("key", F.col("src").alias("id"), "n", "pos", "comp"))
    blocks, many = _counted(_blocks(entries)) if many else (entries, 0)
    if many:
        for nearest in (True, False):
            rows = blocks.join(_joined(links, sketches.select("id", "bits")), "id").select("key", "a", "b", "chunk", "id", "n", "pos", "comp", "bits")
            found = rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(tidy(_long_lists(similarity, nearest)), "src long, dst long")
            links = links.unionByName(similar_pairs(texts, sketches, found, width, similarity))
    comps = connected_components(links)
    roots = classes.join(comps, F.col("first") == F.col("node"), "left").where("node is not null or copies > 1").select("words", F.coalesce("component", "first").alias("component"))
    return one.join(roots, "words").select("id", "component")
