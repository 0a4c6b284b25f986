"""Suffix sorting with common prefixes by external, recursive induction, in batches.

Induced sorting places every suffix by the suffix that follows it. Tuples (place, common prefix with the tuple before it) wait in a
priority queue whose priorities are the first symbols; ranks arrive in order, so the queue is one first-in-first-out list of
blocks per symbol. A block is taken from the least symbol, its predecessors are dealt to the lists of their own symbols by a
stable radix sort, and so on: first the L-suffixes upward, then the S-suffixes downward. Two neighbours in a list share one symbol more than what
their followers share, which is the least common prefix between the two places where those were taken: a range minimum inside the block
and a running minimum per symbol across blocks.

Leftmost S-suffixes are sorted first: their substrings by induction; equal substrings get equal names. Unless all differ, the string of names
(in digits, so that the alphabet stays small) is sorted by the same induction, recursively, common prefixes included, until at most ``BASE``
names are left, which are sorted in memory by doubling. Common prefixes in names become symbols by the places of the names,
plus what the first unequal substrings share.

Everything of the text's length (symbols, types, order, common prefixes) and the blocks of the queues lie in a ``Scratch``: in memory up to a
bound, then in one file in Spark's own local folders, like the spill of a shuffle; it is gone with the task. Places are 64-bit where a text needs it.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections import deque

import numpy as np

#: Bytes that a scratch keeps in memory; the rest lies on disk.
HELD = 256 << 20
#: Elements that are worked on at once.
BLOCK = 1 << 19
#: Names that are sorted in memory: where the recursion ends.
BASE = 4 << 20
#: More names than this are written in two digits; a string of names has at most this share of its text's length, so the recursion ends.
DIGITS, SHORTER = 1 << 11, 0.8


class Scratch:
    """Arrays in memory up to a bound, then in a file that is removed when closed."""

    def __init__(self, held: int | None = None):
        self.left, self.file, self.end, self.spooled = HELD if held is None else held, None, 0, 0

    def _place(self, size: int) -> int:
        if self.file is None:
            folders = [x for x in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if x and os.path.isdir(x)]
            self.file = tempfile.TemporaryFile(dir=folders[os.getpid() % len(folders)] if folders else None)
        at, self.end = self.end, self.end + size + -size % 8
        self.spooled += size
        return at

    def array(self, n: int, kind) -> np.ndarray:
        """An array of zeros; it takes its share of the memory for good."""
        size = n * np.dtype(kind).itemsize
        if size <= self.left or not n:
            self.left -= size
            return np.zeros(n, kind)
        at = self._place(size)
        self.file.truncate(self.end)
        return np.memmap(self.file, kind, "r+", at, (n,))

    def put(self, x: np.ndarray):
        """Keeps a block: a handle for ``get``."""
        if x.nbytes <= self.left:
            self.left -= x.nbytes
            return x
        at = self._place(x.nbytes)
        self.file.seek(at)
        self.file.write(x.tobytes())
        return at, len(x), x.dtype

    def get(self, x, keep: bool = False) -> np.ndarray:
        if isinstance(x, tuple):
            self.file.seek(x[0])
            return np.frombuffer(self.file.read(x[1] * x[2].itemsize), x[2])
        if not keep:
            self.left += x.nbytes
        return x

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def blocks(n: int):
    for lo in range(0, n, BLOCK):
        yield lo, min(n, lo + BLOCK)


def s_types(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Whether each suffix is smaller than the next one, from the end backward. The last symbol is a unique smallest one."""
    n = len(text)
    out = scratch.array(n, bool)
    out[n - 1] = True
    for lo in range((n - 2) // BLOCK * BLOCK, -1, -BLOCK):
        hi = min(n - 1, lo + BLOCK)
        now, after = text[lo:hi], text[lo + 1 : hi + 1]
        differs = np.flatnonzero(now != after)
        where = np.searchsorted(differs, np.arange(hi - lo))
        up = np.append(now[differs] < after[differs], out[hi])  # equal to the block's end: as what follows
        out[lo:hi] = up[where]
    return out


class Minima:
    """Range minima of an array by doubling."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        spans = 1 << np.arange(max(1, n.bit_length()))
        ends = np.cumsum(n - spans + 1) if n else spans * 0
        self.first, self.rows = np.append(0, ends[:-1]), np.empty(int(ends[-1]), x.dtype)  # the rows of all levels, one after the other
        self.rows[:n] = x
        for k in range(1, len(spans) if n else 0):
            last, half = self.rows[self.first[k - 1] : ends[k - 1]], int(spans[k - 1])
            np.minimum(last[:-half], last[half:], out=self.rows[self.first[k] : ends[k]])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of x[lo:hi], lo < hi."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        at = self.first[level]
        return np.minimum(self.rows[at + lo], self.rows[at + hi - (1 << level)])


def shared(text: np.ndarray, a: int, b: int, depth: int) -> int:
    """The common prefix of two suffixes, up to depth."""
    most = min(depth, len(text) - max(a, b))
    differs = np.flatnonzero(text[a : a + most] != text[b : b + most])
    return int(differs[0]) if len(differs) else most


class Lists:
    """The priority queue: per symbol, blocks of (places, common prefixes) in order; and what a later tuple shares with the last one of each list."""

    def __init__(self, symbols: int, depth: int, scratch: Scratch):
        self.lists: dict[int, deque] = {}
        self.depth, self.scratch, self.common = depth, scratch, depth > 0
        self.least, self.used = np.zeros(symbols, np.int64), np.zeros(symbols, bool)

    def take(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        """The next blocks of a symbol, about BLOCK tuples together."""
        places, prefixes, n = [], [], 0
        while self.lists[c] and n < BLOCK:
            x, y = self.lists[c].popleft()
            places.append(self.scratch.get(x))
            prefixes.append(self.scratch.get(y) if self.common else None)
            n += len(places[-1])
        if not self.lists[c]:
            del self.lists[c]
        return np.concatenate(places), np.concatenate(prefixes) if self.common else None

    def deal(self, before: np.ndarray, kind: np.ndarray, at: np.ndarray, prefixes: np.ndarray | None) -> None:
        """Predecessors (places, first symbols) of the block's tuples ``at``; prefixes: of the whole block, each with the tuple taken before."""
        # 16-bit numbers have a radix sort; a stable sort of wider ones merges
        order = np.argsort(kind.astype(np.uint16) if len(self.least) <= 1 << 16 else kind, kind="stable")
        before, kind, at = before[order], kind[order], at[order]
        edge = np.flatnonzero(np.append(True, kind[1:] != kind[:-1])) if len(kind) else np.zeros(0, np.int64)
        ends = np.append(edge[1:], len(kind)) if len(edge) else edge
        if self.common:
            minima = Minima(prefixes)
            since = np.empty(len(at), np.int64)
            inner = np.ones(len(at), bool)
            inner[edge] = False
            inner = np.flatnonzero(inner)
            since[inner] = minima.of(at[inner - 1] + 1, at[inner] + 1)
            heads = kind[edge]
            first = np.minimum(self.least[heads], minima.of(np.zeros(len(edge), np.int64), at[edge] + 1)) if len(edge) else self.least[:0]
            since[edge] = np.where(self.used[heads], first, -1)
            own = np.minimum(since + 1, self.depth).astype(np.uint16)
            self.least = np.minimum(self.least, int(prefixes.min()))
            last = at[ends - 1]
            tail = last + 1 < len(prefixes)
            self.least[heads] = self.depth
            self.least[heads[tail]] = minima.of(last[tail] + 1, np.full(int(tail.sum()), len(prefixes)))
            self.used[heads] = True
        for a, b in zip(edge.tolist(), ends.tolist(), strict=True):
            self.lists.setdefault(int(kind[a]), deque()).append((self.scratch.put(before[a:b].copy()), self.scratch.put(own[a:b].copy()) if self.common else None))


def induce(text: np.ndarray, seeds: np.ndarray, prefixes: np.ndarray | None, symbols: int, depth: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray | None]:
    """All suffixes in order from the leftmost S-suffixes in order, and (if their common prefixes are given) each one's with the suffix before it, up to depth."""
    n, common = len(text), prefixes is not None
    place = seeds.dtype
    queue = Lists(symbols, depth if common else 0, scratch)
    low: dict[int, list] = {}
    cut = np.zeros(symbols + 1, np.int64)
    for a, b in blocks(len(seeds)):
        cut[1:] += np.bincount(text[seeds[a:b]], minlength=symbols)
    cut = np.cumsum(cut)
    end_low: dict[int, int] = {}  # last L-suffix of a symbol

    def feed(batch: np.ndarray, own: np.ndarray | None, keep) -> None:
        at = np.flatnonzero(batch > 0)
        before = batch[at] - 1
        kind = text[before].astype(np.int64)
        live = keep(kind)
        queue.deal(before[live], kind[live], at[live], own)

    for c in range(symbols):
        while c in queue.lists:
            batch, own = queue.take(c)
            low.setdefault(c, []).append((scratch.put(batch), scratch.put(own) if common else None))
            end_low[c] = int(batch[-1])
            feed(batch, own, lambda kind: kind >= c)
        for a in range(int(cut[c]), int(cut[c + 1]), BLOCK):
            b = min(int(cut[c + 1]), a + BLOCK)
            batch, own = np.asarray(seeds[a:b]), np.array(prefixes[a:b]) if common else None
            if common and a == cut[c]:
                own[0] = shared(text, end_low[c], int(batch[0]), depth) if c in end_low else 0
            feed(batch, own, lambda kind: kind < symbols)
    order, told = scratch.array(n, place), scratch.array(n + 1, np.uint16) if common else None
    queue = Lists(symbols, depth if common else 0, scratch)
    end, last = n, None  # last: the suffix taken before

    def out(batch: np.ndarray, own: np.ndarray | None) -> None:
        nonlocal end, last
        order[end - len(batch) : end] = batch[::-1]
        if common:  # own: with the next greater suffix
            told[end - len(batch) + 1 : end + 1] = own[::-1]
        end, last = end - len(batch), int(batch[-1])

    for c in range(symbols - 1, -1, -1):
        last = None
        while c in queue.lists:
            batch, own = queue.take(c)
            out(batch, own)
            feed(batch, own, lambda kind: kind <= c)
        if c == int(text[n - 1]):  # the last suffix, that nothing induces
            out(np.array([n - 1], place), np.zeros(1, np.uint16) if common else None)
        above, first = 0, True
        for places, shares in reversed(low.pop(c, ())):
            batch, ascending, own = scratch.get(places), scratch.get(shares) if common else None, None
            if common:
                if last is not None and first:
                    above = shared(text, int(batch[-1]), last, depth)
                own = np.append(above, ascending[:0:-1]).astype(np.uint16)
                above, first = int(ascending[0]), False
            out(batch[::-1], own)
            feed(batch[::-1], own, lambda kind: kind < c)
    return order, told[:n] if common else None


def unlike(text: np.ndarray, order: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each substring (sizes as given) differs from the one before it."""
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    differs = size[:-1] != size[1:]
    live, most, k = np.flatnonzero(~differs), size[1:], 0
    while len(live):
        new = text[a[live] + k] != text[b[live] + k]
        differs[live[new]] = True
        k += 1
        live = live[~new]
        live = live[most[live] > k]
    return differs


def extended(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of the suffixes a and b, of which ``known`` symbols agree, up to depth."""
    out, n = np.minimum(known, depth), len(text)
    live, step = np.flatnonzero(out < depth), 1
    while len(live):  # most pairs part at once; what is left is compared by more and more symbols a round
        rows = np.lib.stride_tricks.sliding_window_view(text, step) if step > 1 else text
        kept = []
        most = max(1, BLOCK // step)
        for lo in range(0, len(live), most):
            own = live[lo : lo + most]
            x, y = a[own] + out[own], b[own] + out[own]
            fits = np.maximum(x, y) + step <= n
            if not fits.all():
                for i in own[~fits].tolist():  # near the end of the text
                    out[i] += shared(text, int(a[i] + out[i]), int(b[i] + out[i]), depth - int(out[i]))
                own, x, y = own[fits], x[fits], y[fits]
            if step == 1:
                own = own[rows[x] == rows[y]]
                out[own] += 1
            else:
                unequal = rows[x] != rows[y]
                first = unequal.argmax(1)
                parts = unequal[np.arange(len(own)), first]
                out[own] = np.minimum(out[own] + np.where(parts, first, step), depth)
                own = own[~parts]
            kept.append(own[out[own] < depth])
        live, step = np.concatenate(kept), min(32, 2 * step, n)
    return out


def suffixes(text: np.ndarray, depth: int, scratch: Scratch, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix of each suffix with the one before it, up to depth) of symbols below ``symbols``; the last one is smallest and unique."""
    n = len(text)
    place = np.int32 if n < 1 << 31 else np.int64
    if n == 1:
        return np.zeros(1, place), np.zeros(1, np.uint16)
    small = s_types(text, scratch)
    starts = scratch.array(sum(int(np.count_nonzero(small[lo + 1 : hi + 1] & ~small[lo:hi])) for lo, hi in blocks(n - 1)), place)
    at = 0
    for lo, hi in blocks(n - 1):
        own = np.flatnonzero(small[lo + 1 : hi + 1] & ~small[lo:hi]) + lo + 1
        starts[at : at + len(own)] = own
        at += len(own)
    m = len(starts)
    if m < 2:
        return induce(text, np.asarray(starts), np.zeros(m, np.uint16), symbols, depth, scratch)
    rough, _ = induce(text, starts[np.argsort(text[starts], kind="stable")], None, symbols, 0, scratch)
    index = scratch.array(n, place)  # of each start, from 1
    index[starts] = np.arange(1, m + 1)
    order = scratch.array(m, place)
    at = 0
    for lo, hi in blocks(n):
        own = rough[lo:hi]
        own = own[index[own] > 0]
        order[at : at + len(own)] = index[own] - 1
        at += len(own)
    del rough, index
    size = scratch.array(m, place)
    size[:-1] = starts[1:] - starts[:-1] + 1
    size[-1] = 1
    names, number = scratch.array(m, place), 0
    last = None
    for lo, hi in blocks(m):
        own = np.asarray(order[lo:hi])
        both = own if last is None else np.append(last, own)
        new = unlike(text, starts[both], size[both])
        got = number + np.cumsum(np.append(last is None, new) if last is None else new)
        names[own], number, last = got, int(got[-1]), own[-1]
    if number == m:  # names from 1, all different
        agree = scratch.array(m, np.uint16)
    else:
        order, agree = _by_names(names, number, n, depth, scratch, place)
    seeds, prefixes = scratch.array(m, place), scratch.array(m, np.uint16)
    for lo, hi in blocks(m):
        own = np.asarray(order[lo:hi]).astype(np.int64)
        seeds[lo:hi] = starts[own]
        before = np.append(order[lo - 1], own[:-1]).astype(np.int64) if lo else np.append(own[0], own[:-1])
        equal = np.asarray(agree[lo:hi]).astype(np.int64)
        reach = np.minimum(np.maximum(before, own) + equal, m - 1) - np.maximum(before, own)
        known = (starts[own + reach] - starts[own]).astype(np.int64)
        prefixes[lo:hi] = extended(text, starts[before].astype(np.int64), starts[own].astype(np.int64), known, depth)
    prefixes[0] = 0
    return induce(text, seeds, prefixes, symbols, depth, scratch)


def ranks(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string in memory by at least depth names: groups of equal ones are split by what follows them, 1, 2, 4, ... names on."""
    n = len(names)
    order = np.argsort(names * n + np.arange(n))
    new = np.append(True, names[order][1:] != names[order][:-1])
    rank, span = np.empty(n, np.int64), 1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots = np.arange(n)
    while span < depth:
        slots = slots[~(new & np.append(new[1:], True))]  # members of groups of more than one
        if not len(slots):
            break
        own = order[slots]
        after = np.where(own + span < n, rank[np.minimum(own + span, n - 1)], -1)
        head = rank[own]
        by = np.argsort(head * (n + 1) + after)  # one key of both: at most BASE names
        own, after, head = own[by], after[by], head[by]
        order[slots] = own
        new = np.append(True, (head[1:] != head[:-1]) | (after[1:] != after[:-1]))
        rank[own] = np.maximum.accumulate(np.where(new, slots, 0))
        span *= 2
    return order


def _by_names(names: np.ndarray, number: int, n: int, depth: int, scratch: Scratch, place) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of the string of names (from 1), and how many names each shares with the one before it (half of depth at most: a substring has two symbols)."""
    m = len(names)
    if m <= BASE:
        names = np.asarray(names).astype(np.int64)
        order = ranks(names, depth // 2 + 1)
        return order, np.append(0, extended(names, order[:-1], order[1:], np.zeros(m - 1, np.int64), depth // 2 + 1)).astype(np.uint16)
    # two digits keep the alphabet small, unless the string would hardly be shorter than the text
    digits = 1 if number + 2 <= DIGITS or 2 * m + 1 > SHORTER * n else 2
    base = number + 2 if digits == 1 else math.isqrt(number) + 3
    string = scratch.array(m * digits + 1, np.uint16 if base <= 1 << 16 else np.int32)
    for lo, hi in blocks(m):
        own = np.asarray(names[lo:hi]).astype(np.int64)
        for k in range(digits):
            string[lo * digits + k : hi * digits : digits] = own // (base - 2) ** (digits - 1 - k) % (base - 2) + 1 if digits > 1 else own
    inner, prefixes = suffixes(string, (depth // 2 + 1) * digits, scratch, base)
    order, agree = scratch.array(m, place), scratch.array(m, np.uint16)
    at, least = 0, 1 << 15
    for lo, hi in blocks(len(inner)):
        own, shares = np.asarray(inner[lo:hi]).astype(np.int64), np.asarray(prefixes[lo:hi])
        whole = np.flatnonzero((own % digits == 0) & (own < m * digits))
        if not len(whole):
            least = min(least, int(shares.min()))
            continue
        low = np.minimum.reduceat(shares[: whole[-1] + 1], np.append(0, whole[:-1] + 1))
        low[0] = min(int(low[0]), least)
        order[at : at + len(whole)], agree[at : at + len(whole)] = own[whole] // digits, low // digits
        at += len(whole)
        rest = shares[whole[-1] + 1 :]
        least = int(rest.min()) if len(rest) else 1 << 15
    agree[0] = 0
    return order, agree


def suffix_order(text: np.ndarray, depth: int, held: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``suffixes`` with a scratch of its own, as arrays in memory."""
    scratch = Scratch(held)
    try:
        order, prefixes = suffixes(text, depth, scratch, int(text.max()) + 1)
        return np.array(order), np.array(prefixes)
    finally:
        scratch.close()
