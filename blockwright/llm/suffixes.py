"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays; and the stretches that can repeat.

Induced sorting follows its definition, a window of slots at a time: what the window's suffixes induce is written at
once, up to the first slot that they write to themselves. Everything here works on one shard of bounded size.
"""

from __future__ import annotations

import numpy as np

#: No byte of UTF-8; it ends every stretch of a shard.
STOP = 255
#: Hashes of grams: an odd base, and a factor that mixes their bits.
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Windows whose least grams are sought at once.
AT_ONCE = 1 << 18
#: Slots of a suffix array that a step looks at.
MOST_SLOTS = 1 << 16
_COUNT = np.arange(MOST_SLOTS)


def _is_smaller(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one; ``t`` ends with its only smallest symbol."""
    n = len(t)
    other = np.where(t[:-1] == t[1:], n, np.arange(n - 1))
    turn = np.minimum.accumulate(other[::-1])[::-1]  # where the run of equal symbols ends
    return np.append((t[:-1] < t[1:])[turn], True)


def _sweep(sa: np.ndarray, t: np.ndarray, placed: np.ndarray, head: np.ndarray) -> None:
    """Scan ``sa`` and put the suffix before each one met at the head of its bucket, if ``placed`` says so."""
    i, n, width = 0, len(sa), 1024
    while i < n:
        slots = sa[i : i + width]
        taken = len(slots)
        at = (slots > 0).nonzero()[0]
        before = slots[at] - 1
        keep = placed[before].nonzero()[0]
        end = i + taken
        if len(keep):
            before = before[keep]
            symbol = t[before]
            stop = int(head[symbol].min())
            if stop < end:
                end = stop
                m = int(at[keep].searchsorted(stop - i))
                before, symbol = before[:m], symbol[:m]
            order = symbol.argsort(kind="stable")
            symbol = symbol[order]
            to = head[symbol] + (_COUNT[: len(symbol)] - symbol.searchsorted(symbol))
            sa[to] = before[order]
            head[symbol] = to + 1  # of equal symbols the last one counts
        width = min(64 + (end - i) * 5 // 4 if end < i + taken else 2 * width, MOST_SLOTS)
        i = end


def _induce(t: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All suffixes, from leftmost smaller ones in the order of ``seeds``: larger ones from the left, then smaller ones from the right."""
    n, end = len(t), np.cumsum(count)
    sa = np.full(n, -1, np.int32)
    symbol = t[seeds]
    order = np.argsort(symbol, kind="stable")
    symbol = symbol[order]
    own = np.bincount(symbol, minlength=len(count))
    slots = end[symbol] - own[symbol] + np.arange(len(symbol)) - (np.cumsum(own) - own)[symbol]
    sa[slots] = seeds[order]
    _sweep(sa, t, ~smaller, end - count)
    sa[slots[slots > 0]] = -1
    _sweep(sa[::-1], t, smaller, n - end)
    return sa


def suffix_array(t: np.ndarray, symbols: int) -> np.ndarray:
    """Order of all suffixes of ``t``, whose last symbol is its only 0."""
    n = len(t)
    t = t.astype(np.uint16 if symbols <= 1 << 16 else np.int32, copy=False)  # two bytes are sorted by radix
    if n < 3:
        return np.arange(n, dtype=np.int32)[::-1].copy()
    smaller = _is_smaller(t)
    leftmost = np.append(False, smaller[1:] & ~smaller[:-1])
    places = np.flatnonzero(leftmost)
    count = np.bincount(t, minlength=symbols)
    if len(places) > 1:
        sa = _induce(t, smaller, places, count)
        ranked = sa[leftmost[sa]]
        # Name the substrings from one leftmost smaller suffix to the next; equal neighbours have one name.
        size = np.zeros(n, np.int64)
        size[places] = np.diff(np.append(places, n - 1))
        a, b = ranked[:-1], ranked[1:]
        differs = size[a] != size[b]
        open_ = np.flatnonzero(~differs)
        step = 0
        while len(open_):
            unequal = t[a[open_] + step] != t[b[open_] + step]
            differs[open_[unequal]] = True
            open_ = open_[~unequal & (size[a[open_]] > step)]
            step += 1
        names = np.append(0, np.cumsum(differs))
        if names[-1] + 1 == len(places):
            places = ranked
        else:
            name = np.zeros(n, np.int32)
            name[ranked] = names
            places = places[suffix_array(name[places], int(names[-1]) + 1)]
    return _induce(t, smaller, places, count)


def common_prefixes(data: np.ndarray, sa: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, in text order, the suffix before it in ``sa`` (or -1) and the bytes they share, up to ``room``.

    A place whose left neighbour is also the other's left neighbour shares one byte less than that one does; only the
    rest is compared, eight bytes a step. ``room`` falls by one a place down to 0 at the end of a stretch.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    places = np.arange(n)
    left = (before > 0) & (np.append(0, room[:-1]) > 0)
    left[left] = data[places[left] - 1] == data[before[left] - 1]
    heads = np.flatnonzero(~left)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    shared = np.zeros(len(heads), np.int64)
    open_ = np.flatnonzero((before[heads] >= 0) & (room[heads] > 0))
    step = 0
    while len(open_):
        a, b = heads[open_] + step, before[heads[open_]] + step
        inside = b < n
        x = words[a] ^ words[np.minimum(b, n)]
        low = np.frexp((x & (~x + np.uint64(1))).astype(np.float64))[1] - 1  # the lowest bit that differs
        same = np.where(x == 0, 8, low // 8)
        shared[open_] += np.where(inside, same, 0)
        step += 8
        open_ = open_[(x == 0) & inside & (room[heads[open_]] > step)]
    last = np.cumsum(~left) - 1
    out = shared[last] - (places - heads[last])
    return before, np.minimum(np.maximum(out, 0), room)


def repeated_runs(stretches: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each stretch, the runs of bytes that strings of ``length`` cover which start at another place of any stretch too."""
    data = np.frombuffer(b"\xff".join(stretches) + b"\xff", np.uint8)
    size = np.array([len(s) for s in stretches])
    start = np.cumsum(size + 1) - size - 1
    sa = suffix_array(np.append(data.astype(np.int32) + 1, np.int32(0)).astype(np.int32), 257)[1:]
    owner = np.repeat(np.arange(len(stretches)), size + 1)
    room = start[owner] + size[owner] - np.arange(len(data))
    before, shared = common_prefixes(data, sa, room)
    twice = np.zeros(len(data), bool)
    found = shared >= length
    twice[found] = True
    twice[before[found]] = True
    out: list[list[tuple[int, int]]] = [[] for _ in stretches]
    hits = np.flatnonzero(twice)
    if len(hits):
        opens = np.append(True, (np.diff(hits) > length) | (owner[hits[1:]] != owner[hits[:-1]]))
        first, last = hits[opens], hits[np.append(opens[1:], True)]
        for o, a, b in zip(owner[first].tolist(), first.tolist(), last.tolist(), strict=True):
            out[o].append((a - int(start[o]), b - int(start[o]) + length))
    return out


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or next(iter(_POWERS)) < n:
        inverse = pow(BASE, -1, 1 << 64)
        both = []
        for b in (BASE, inverse):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _POWERS.clear()
        _POWERS[n] = (both[0], both[1])
    return next(iter(_POWERS.values()))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(AT_ONCE + 4096 if len(data) <= AT_ONCE + 4096 else len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= up[: len(data)]
    np.cumsum(terms, out=total[1:])
    h = total[gram:] - total[:n]
    h *= down[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(MIX)
    h ^= h >> np.uint64(29)
    return h


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    back = np.minimum.accumulate(table, axis=1).reshape(-1)
    return np.minimum(ahead[:n], back[width - 1 : width - 1 + n])


def anchored(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, lo, hi, at, key): runs of window starts of one text whose ``length``-byte windows have the same least gram.

    ``data`` holds texts end to end. Equal windows have their least gram (the first of equals) at the same place in
    them, wherever they are: two equal windows always lie in runs of the same key, aligned at ``at``.
    """
    width, parts = length - gram + 1, []
    for s in range(0, max(0, len(data) - length + 1), AT_ONCE):
        part = data[s : s + AT_ONCE + length - 1]
        h = gram_hashes(part, gram)
        place = np.uint64((1 << 24) - 1)
        least = h & ~place
        least |= np.arange(len(h), dtype=np.uint64)
        least = least_in_windows(least, width)
        new = np.empty(len(least), bool)  # where a run begins: at another least gram, a text, or the first window that leaves its text
        new[0] = True
        np.not_equal(least[1:], least[:-1], out=new[1:])
        edges = np.concatenate((offsets, offsets[1:] - length + 1)) - s
        new[edges[(edges >= 0) & (edges < len(new))]] = True
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(new)) - 1 + s
        best = (least[lo] & place).astype(np.int64)
        lo += s
        text = np.searchsorted(offsets, lo, side="right") - 1
        whole = lo + length <= offsets[text + 1]
        lo, hi, best, text = lo[whole], hi[whole], best[whole], text[whole]
        if len(lo):
            parts.append((text, lo - offsets[text], hi - offsets[text], best + s - offsets[text], h[best].view(np.int64)))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
