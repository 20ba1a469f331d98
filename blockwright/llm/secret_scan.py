"""Secret scans: fixed patterns, and formats learnt by grammar inference.

The patterns' own finds are the labelled credentials. From a bounded sample of them (``SAMPLE`` distinct values of
each kind, those with the smallest hashes) a prefix tree is built for each kind, and states whose outgoing
frequencies are statistically compatible (Hoeffding bound) are merged into a probabilistic automaton (Carrasco and
Oncina's ALERGIA). Every token of every whole text outside the base spans is a candidate, whatever its length, and
is scored by all automata, many tokens in step. It becomes a span when its likelihood under an automaton is what a
value of its length has (within ``SPREAD`` standard deviations), and so much above its likelihood as an ordinary
token, whose steps from class to class are counted over all texts, that this outweighs how many more of those there are.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_runs, tidy

#: Base patterns (fixed values), in the order of kinds.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN = 6
#: Labelled values of each kind that an automaton is learnt from, and their length, at most. Both bound what the driver holds.
SAMPLE, LONGEST = 400, 4096
#: Standard deviations that a token's likelihood may lie below what a value of its length has.
SPREAD = 3.0
#: Bytes of text whose tokens are scored at once; longer texts are cut between tokens.
PIECE = 2 << 20
#: Tokens above this length are scored one by one.
LONG = 4096
RUN_BYTES = 8 << 20


def base_spans(text: str, maybe: tuple[bool, bool, bool] = (True, True, True)) -> list[tuple[int, int, int, str]]:
    """(start, kind's rank, end, value), leftmost and non-overlapping within each kind; short finds are dropped after they took their place."""
    found = []
    if maybe[0]:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if maybe[1]:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    if maybe[2]:
        found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


#: Classes of characters: digits, a-f, g-z, A-F, G-Z, marks; any other byte ends a token.
CLASSES, MARK = 6, 5
_CLASS = np.full(256, -1, np.int8)
for _k, _chars in enumerate(("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/_.=-")):
    _CLASS[[ord(c) for c in _chars]] = _k


def symbols(value: str) -> list[int]:
    """Classes of the characters."""
    return _CLASS[np.frombuffer(value.encode("ascii"), np.uint8)].tolist()


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """(start, end, text) of stretches of texts, cut between tokens where a text is longer than a piece."""
    for k, (at, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while end - at > PIECE:
            stop = at + PIECE
            while stop < end and not (gap := np.flatnonzero(_CLASS[data[stop : stop + LONG]] < 0)).size:
                stop += LONG
            stop = min(end, stop + int(gap[0])) if stop < end else end
            yield at, stop, k
            at = stop
        if end > at:
            yield at, end, k


def tokens(data: np.ndarray, bounds: list[tuple[int, int, int]]):
    """(classes, starts, ends, texts) of the tokens of stretches that follow one another: runs of class characters that begin and end with no mark."""
    base, stop = bounds[0][0], bounds[-1][1]
    classes = _CLASS[data[base:stop]]
    inside = classes >= 0
    fresh = np.zeros(len(classes) + 1, bool)
    fresh[[a - base for a, _, _ in bounds]] = fresh[-1] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | fresh[:-1]))
    ends = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | fresh[1:])) + 1
    place = np.arange(len(classes), dtype=np.int32)
    solid = inside & (classes != MARK)
    a = np.minimum.accumulate(np.where(solid, place, len(classes))[::-1])[::-1][starts] if len(starts) else starts
    b = np.maximum.accumulate(np.where(solid, place, -1))[ends - 1] + 1 if len(ends) else ends
    keep = (a < ends) & (b > starts)
    a, b = a[keep].astype(np.int64), b[keep].astype(np.int64)
    texts = np.array([k for *_, k in bounds])[np.searchsorted([x - base for x, _, _ in bounds], a, side="right") - 1]
    return classes, a, b, texts


def _steps(classes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often tokens step from class to class; the last row and column stand for their starts and ends."""
    owner = np.zeros(len(classes) + 1, np.int8)
    np.add.at(owner, starts, 1), np.add.at(owner, ends, -1)
    inside = np.cumsum(owner[:-1]).astype(bool)
    first = np.zeros(len(classes), bool)
    first[starts] = True
    at = np.flatnonzero(inside & ~first)
    wide = CLASSES + 1
    out = np.bincount(classes[at - 1].astype(np.int64) * wide + classes[at], minlength=wide * wide).reshape(wide, wide)
    out[CLASSES, :CLASSES] += np.bincount(classes[starts], minlength=CLASSES)
    out[:CLASSES, CLASSES] += np.bincount(classes[ends - 1], minlength=CLASSES)
    return out


class Automaton:
    """A probabilistic automaton: for each state its visits, ends, and counted steps."""

    def __init__(self, values: list[str], alpha: float = 0.05, least: int = 12):
        self.visits, self.ends, self.next, self.count = [0], [0], [{}], [{}]
        for value in values:
            at = 0
            self.visits[0] += 1
            for s in symbols(value):
                if s not in self.next[at]:
                    self.next[at][s] = len(self.visits)
                    self.count[at][s] = 0
                    self.visits.append(0), self.ends.append(0), self.next.append({}), self.count.append({})
                self.count[at][s] += 1
                at = self.next[at][s]
                self.visits[at] += 1
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.least = least
        self._merge()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.visits[a], self.visits[b]
            if na < self.least or nb < self.least:
                continue  # too few to tell apart
            if self._differ(self.ends[a], na, self.ends[b], nb):
                return False
            for s in self.next[a].keys() | self.next[b].keys():
                if self._differ(self.count[a].get(s, 0), na, self.count[b].get(s, 0), nb):
                    return False
                if s in self.next[a] and s in self.next[b]:
                    todo.append((self.next[a][s], self.next[b][s]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for s, to in self.next[b].items():
                if s in self.next[a]:
                    self.count[a][s] += self.count[b][s]
                    todo.append((self.next[a][s], to))
                else:
                    self.next[a][s], self.count[a][s] = to, self.count[b][s]

    def _merge(self) -> None:
        red = [0]
        while True:
            inside = set(red)
            blue = [(a, s, to) for a in red for s, to in self.next[a].items() if to not in inside]
            if not blue:
                break
            a, s, b = max(blue, key=lambda x: (self.visits[x[2]], -x[2]))
            for r in red:
                if self._compatible(r, b):
                    self.next[a][s] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)

    def steps(self, value: str) -> list[float]:
        """Natural logarithms of the probabilities of a learnt value's characters."""
        at, out = 0, []
        for s in symbols(value):
            out.append(math.log(self.count[at][s] / self.visits[at]))
            at = self.next[at][s]
        return out

    def score(self, value: str) -> float:
        """Natural logarithm of the likelihood, end included, per character."""
        at, total = 0, 0.0
        syms = symbols(value)
        for s in syms:
            if not self.count[at].get(s):
                return -math.inf
            total += math.log(self.count[at][s] / self.visits[at])
            at = self.next[at][s]
        if not self.ends[at]:
            return -math.inf
        return (total + math.log(self.ends[at] / self.visits[at])) / (len(syms) + 1)


    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(next state, logarithm of the step's probability, of the end's) by state; the last state is where no value goes."""
        n = len(self.visits)
        to, step, end = np.full((n + 1, CLASSES), n, np.int64), np.full((n + 1, CLASSES), -np.inf), np.full(n + 1, -np.inf)
        for k in range(n):
            for s, c in self.count[k].items():
                if c:
                    to[k, s], step[k, s] = self.next[k][s], math.log(c / self.visits[k])
            if self.ends[k]:
                end[k] = math.log(self.ends[k] / self.visits[k])
        return to, step, end


def likelihoods(tables, classes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Logarithm of each token's likelihood; all tokens take their steps together, longest first."""
    to, step, end = tables
    sink = len(to) - 1
    size = ends - starts
    out = np.full(len(starts), -np.inf)
    order = np.argsort(-size, kind="stable")
    for k in order[: int((size > LONG).sum())].tolist():
        at, total = 0, 0.0
        for s in classes[starts[k] : ends[k]].tolist():
            total += step[at, s]
            at = int(to[at, s])
            if at == sink:
                break
        out[k] = total + end[at]
    live = order[int((size > LONG).sum()) :]
    state, total, t = np.zeros(len(live), np.int64), np.zeros(len(live)), 0
    while len(live):
        s = classes[starts[live] + t]
        total += step[state, s]
        state = to[state, s]
        t += 1
        over = size[live] == t
        out[live[over]] = total[over] + end[state[over]]
        stay = ~over & (state != sink)
        live, state, total = live[stay], state[stay], total[stay]
    return out


class Grammar:
    """The automata of all kinds with their thresholds, and the steps of ordinary tokens; its size is bounded by the sample."""

    def __init__(self, labelled: dict[str, list[str]], steps: np.ndarray | None = None):
        counts = (np.zeros((CLASSES + 1, CLASSES + 1)) if steps is None else steps) + 0.5
        counts[CLASSES, CLASSES] = 0
        with np.errstate(divide="ignore"):
            self.ordinary = np.log(counts / counts.sum(axis=1, keepdims=True))
        many = max(1, int(counts[CLASSES].sum()))
        self.kinds = []
        for k, kind in enumerate(KINDS):
            values = sorted(set(labelled.get(kind, [])))
            if not values:
                continue
            automaton = Automaton(values)
            steps = np.array([x for v in values for x in automaton.steps(v)])
            self.kinds.append((k, automaton.tables(), steps.mean(), steps.std(), math.log(max(1.0, many / len(values)))))

    def accept(self, classes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each token the rank of the kind that likes it best, if one likes it well enough, else -1."""
        best, gain = np.full(len(starts), -1), np.full(len(starts), -np.inf)
        size = ends - starts
        for k, tables, mean, spread, odds in self.kinds:
            own = likelihoods(tables, classes, starts, ends)
            maybe = np.flatnonzero(own >= size * mean - SPREAD * spread * np.sqrt(size) + tables[2][:-1].min(where=np.isfinite(tables[2][:-1]), initial=0) - 1e-9)
            if not len(maybe):
                continue
            more = own[maybe] - self.usual(classes, starts[maybe], ends[maybe])
            better = (more >= odds) & (more > gain[maybe])
            best[maybe[better]], gain[maybe[better]] = k, more[better]
        return best

    def usual(self, classes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Logarithm of the likelihood of tokens among ordinary ones."""
        out = self.ordinary[CLASSES, classes[starts]] + self.ordinary[classes[ends - 1], CLASSES]
        inner = ends - starts - 1
        if inner.any():
            at = np.repeat(starts + 1 - (np.cumsum(inner) - inner), inner) + np.arange(int(inner.sum()))
            out += np.bincount(np.repeat(np.arange(len(starts)), inner), weights=self.ordinary[classes[at - 1], classes[at]], minlength=len(starts))
        return out

    def added(self, texts: pa.Array):
        """(text, first byte, end byte, kind) of the tokens of texts that an automaton accepts, as arrays."""
        none = np.zeros((0, 4), np.int64)
        if not self.kinds or not len(texts):
            return none
        raw = texts.cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] else np.zeros(0, np.uint8)
        out = [none]
        for bounds in _gathered(_pieces(data, offsets)):
            classes, a, b, owner = tokens(data, bounds)
            kind = self.accept(classes, a, b)
            ok = kind >= 0
            out.append(np.stack((owner[ok], a[ok] + bounds[0][0] - offsets[owner[ok]], b[ok] + bounds[0][0] - offsets[owner[ok]], kind[ok]), axis=1))
        return np.concatenate(out)


def _gathered(pieces):
    """Lists of stretches of about a piece in all."""
    held: list[tuple[int, int, int]] = []
    for piece in pieces:
        if held and piece[1] - held[0][0] > PIECE:
            yield held
            held = []
        held.append(piece)
    if held:
        yield held


def untouched(found: list[tuple[int, int, int, str]], base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """The spans that none of the base spans, which are sorted, touches."""
    if not base:
        return found
    starts, ends = np.array([x[0] for x in base]), np.maximum.accumulate([x[2] for x in base])
    before = np.searchsorted(starts, [x[2] for x in found]) - 1  # the last base span that starts ahead of the end
    return [x for x, k in zip(found, before.tolist()) if k < 0 or ends[k] <= x[0]]


NAMES = (*KINDS, *(f"format_{k}" for k in KINDS))


def _maybe(texts: pa.Array) -> np.ndarray:
    """For each text, which base patterns could find something; a linear-time engine looks over all of it."""
    yes = [
        pc.match_substring_regex(texts, r"password|passwd|secret|token|api_?key", ignore_case=True),
        pc.match_substring_regex(texts, r"AKIA[A-Z0-9]{16}"),
        pc.match_substring_regex(texts, r"[0-9a-f]{24}"),
    ]
    return np.stack([y.to_numpy(zero_copy_only=False) for y in yes], axis=1)


def learn(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Grammar:
    """The grammar of the values that the base patterns find over all documents, and of all tokens beside them.

    Each kind is learnt from the ``sample`` distinct values with the smallest hashes, of LONGEST characters at most.
    """

    def run(batches):
        steps = np.zeros((CLASSES + 1, CLASSES + 1), np.int64)
        for batch in batches:
            for part in text_runs(batch, 0, RUN_BYTES):
                texts = pc.fill_null(part.column(0), "")
                maybe = _maybe(texts)
                kinds, values, blank = [], [], {}
                for i in np.flatnonzero(maybe.any(axis=1)).tolist():
                    text = texts[i].as_py()
                    rest, at = [], 0
                    for a, k, b, v in base_spans(text, tuple(maybe[i])):
                        if len(v) <= LONGEST:
                            kinds.append(KINDS[k]), values.append(v)
                        rest.append(text[at : max(at, a)])
                        at = max(at, b)
                    if at:
                        blank[i] = " ".join([*rest, text[at:]])
                if blank:
                    texts = pc.if_else(pa.array([i in blank for i in range(len(texts))]), pa.array([blank.get(i) for i in range(len(texts))], texts.type), texts)
                raw = texts.cast(pa.large_binary())
                offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
                data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] else np.zeros(0, np.uint8)
                for bounds in _gathered(_pieces(data, offsets)):
                    classes, a, b, _ = tokens(data, bounds)
                    steps += _steps(classes, a, b)
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array([0] * len(kinds), pa.int64())], names=["kind", "value", "n"])
        used = np.argwhere(steps)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.string()), pa.array([f"{x} {y}" for x, y in used], pa.string()), pa.array(steps[tuple(used.T)], pa.int64())], names=["kind", "value", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "kind string, value string, n long")
    distinct = cut(found.groupBy("kind", "value").agg(F.sum("n").alias("n")))
    counted = np.zeros((CLASSES + 1, CLASSES + 1))
    for r in distinct.where("kind is null").collect():  # a row for each step
        counted[tuple(map(int, r["value"].split()))] = r["n"]
    first = lambda k: distinct.where(F.col("kind") == k).select("value").orderBy(F.xxhash64("value"), "value").limit(sample).collect()
    return Grammar({k: [r[0] for r in first(k)] for k in KINDS}, counted)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grammar: Grammar | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, redacted, and the columns of ``keep``) for every document.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind, comma-joined; equal starts of
    one kind cannot be. ``redacted`` is the text with every span replaced. A null text counts as empty for the spans
    and stays null when redacted. Null ids and repeated rows stay, each scanned for itself; an empty table gives no
    rows. Whole texts are scanned; of a very long one the tokens are scored a piece at a time.
    """
    grammar = grammar or learn(docs, text_col)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    schema = "id " + dict(chosen.dtypes)["id"] + ", n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string" + "".join(f", keep_{c} {dict(docs.dtypes)[c]}" for c in keep)

    def run(batches):
        for batch in batches:
            for part in text_runs(batch, 1, RUN_BYTES):
                texts = pc.fill_null(part.column(1), "")
                maybe, n = _maybe(texts), part.num_rows
                counts, sums, spans = np.zeros((n, 3), np.int64), [hashlib.sha256(b"").hexdigest()] * n, [""] * n
                redacted: dict[int, str] = {}
                more: dict[int, list[tuple[int, int, int]]] = {}
                for i, a, b, k in grammar.added(texts).tolist():
                    more.setdefault(i, []).append((a, b, k))
                for i in sorted({*np.flatnonzero(maybe.any(axis=1)).tolist(), *more}):
                    text = texts[i].as_py()
                    base = base_spans(text, tuple(maybe[i]))
                    everything = sorted(base + untouched(_in_points(text, more.get(i, [])), base))
                    if not everything:
                        continue
                    for _, k, _, _ in base:
                        counts[i, k] += 1
                    told = lambda found: ",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b, _ in found)
                    sums[i] = hashlib.sha256(told(base).encode()).hexdigest()
                    spans[i] = told(everything)
                    out, at = [], 0
                    for a, _, b, _ in everything:
                        if b <= at:
                            continue
                        out += [text[at:a], "[SECRET]"] if a >= at else []
                        at = b
                    redacted[i] = "".join([*out, text[at:]])
                clean = part.column(1)
                if redacted:
                    new = pa.array([redacted.get(i) for i in range(n)], clean.type)
                    clean = pc.if_else(pa.array([i in redacted for i in range(n)]), new, clean)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(counts[:, k]) for k in range(3)), pa.array(sums), pa.array(spans), clean, *(part.column(2 + j) for j in range(len(keep)))],
                    names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted", *(f"keep_{c}" for c in keep)],
                )

    return chosen.mapInArrow(tidy(run), schema)


def _in_points(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """Learnt spans, sorted by their first byte, in code points; their ranks follow the base kinds."""
    if not found:
        return []
    data, out, at, points = text.encode(), [], 0, 0
    for a, b, k in found:
        points += len(data[at:a].decode())
        value = data[a:b].decode()
        out.append((points, len(KINDS) + k, points + len(value), value))
        at, points = b, points + len(value)
    return out
