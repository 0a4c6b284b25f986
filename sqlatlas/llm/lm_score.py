r"""LM scoring by context-tree weighting over bytes, and an add-one unigram baseline.

A byte is eight binary decisions. The context of a byte is the ``depth`` bytes before it, as they are: no classes, so cases, digits and
the bytes of longer characters stay apart, and contexts grow with the corpus. Every node of the context tree
holds, for each of the 255 inner nodes of the decision tree, how often each bit followed; the Krichevsky-Trofimov
estimate of a node and the product of its children's weighted probabilities are mixed half and half, at all depths. Counts come
from all training texts. The posterior weights are frozen, so a byte's probability depends on its context only.
A context never seen adds no estimate of its own: its parent's is used. Each text ends with the byte FF, which UTF-8 never holds, and
logarithms are rounded down, so the probabilities of all texts sum to one at most.

The tree is nowhere in one place. A byte with its context is a number of 64 bits; tasks count them, packed, by shards of the last three
bytes. A shard merges its counts and keeps them as a table; its subtrees are whole. The driver gets, for contexts of two bytes, counts and the
product of what lies below (sums over shards), and weighs the upper three depths. To score, documents are gathered
in chunks (compressed, in a table); a chunk asks every shard for its different numbers and gets their logarithms back.

The baseline needs the exact training count of every word: frequent ones (of limited length, at most ``FREQUENT``, from a count that a
histogram of counts gives) are broadcast, the others of a text are joined by word, so no key of the shuffle is hot.

``bits_per_byte`` is the code length: -log2 of the text's probability over its bytes, the end byte included.

Null text counts as empty: one end token, and the end byte. Repeated rows are scored alike and count as often as they occur. With no
training rows every estimate is the prior's. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import blocks, mix, remainder, slices_of, table, tidy, written

#: Bytes of context in the query; a number holds seven at most. The upper depths (to TOP) are weighed by the driver.
DEPTH, TOP = 6, 2
#: The class of a byte in a context: the byte itself, so it needs no lookup here.
CLASS = np.arange(256, dtype=np.uint8)
#: Words whose counts are broadcast: a bound on entries and on bytes each.
FREQUENT, FREQUENT_BYTES = 200_000, 64
HELD_WORDS, BLOCK = 300_000, 2 << 20
#: Bytes of text of a chunk and of a shard on average; numbers that a task holds before it sends them, and whose subtrees are weighed at once.
CHUNK_BYTES, SHARD_BYTES = 16 << 20, 32 << 20
HELD_CODES, TREE_CODES = 1_000_000, 300_000


class Coded:
    """Texts as numbers: the context of each byte (the last byte highest), then the byte; the end byte of each text included."""

    def __init__(self, texts: list[bytes], depth: int):
        fill = b"\xff" * depth
        self.data, self.depth = b"\xff" * 7 + fill.join(texts) + b"\xff", depth
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.sizes + depth) - self.sizes - depth

    def pieces(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, numbers, whether a place has one) of at most BLOCK places; the filling bytes between texts have none."""
        n, depth = len(self.data) - 7, self.depth
        fill = (self.starts + self.sizes)[:-1, None] + np.arange(1, depth)
        for lo in range(0, n, BLOCK):
            hi = min(n, lo + BLOCK)
            live = np.ones(hi - lo, bool)
            own = fill[np.searchsorted(fill[:, -1], lo) : np.searchsorted(fill[:, 0], hi)].ravel() - lo
            live[own[(own >= 0) & (own < hi - lo)]] = False
            whole = np.ndarray((hi - lo,), "<u8", self.data, lo, (1,))[live]  # a byte and the seven before it, the byte highest
            code = whole << np.uint64(8)
            code >>= np.uint64(8 * (8 - depth))
            code <<= np.uint64(8)
            whole >>= np.uint64(56)
            code |= whole
            yield lo, hi, code, live

    def sums(self, codes: np.ndarray, logs: np.ndarray) -> list[float]:
        """By text, the sum of the logs of its numbers; codes: all of them, sorted."""
        out = np.zeros(len(self.sizes))
        for lo, hi, code, live in self.pieces():
            order = np.argsort(code)
            code = code[order]
            new = np.append(True, code[1:] != code[:-1])
            found, value = np.empty(len(code)), np.zeros(hi - lo)
            found[order] = np.repeat(logs[np.searchsorted(codes, code[new])].astype(np.float64), np.diff(np.flatnonzero(new), append=len(code)))
            value[live] = found
            first, stop = np.searchsorted(self.starts, lo, "right") - 1, np.searchsorted(self.starts, hi)
            out[first:stop] += np.add.reduceat(value, np.maximum(self.starts[first:stop] - lo, 0))
        return out.tolist()


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different numbers and how often each occurs; sorts in place."""
    codes.sort()
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[first], np.diff(first, append=len(codes))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers with their counts, from several sorted lists of both."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes, n = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(n, first) if len(first) else n


class Counted:
    """Counts of numbers as they come."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, codes: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((codes, n))
        self.size += len(codes)
        if self.size > max(HELD_CODES, 2 * len(self.parts[0][0])):
            self.all()

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        self.parts = [merged(self.parts)]
        self.size = len(self.parts[0][0])
        return self.parts[0]


def packed(x: np.ndarray) -> bytes:
    """8-byte numbers by planes of bytes, compressed."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(x: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(x, n * 8, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8").astype(np.uint64)


def steps(codes: np.ndarray) -> np.ndarray:
    return np.diff(codes, prepend=np.uint64(0))


def shard_of(codes: np.ndarray, depth: int, shards: int) -> np.ndarray:
    return (mix(codes >> np.uint64(8 * (depth - TOP))) % np.uint64(shards)).astype(np.int64)


def dealt(codes: np.ndarray, depth: int, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, its places in codes) in order of shards, the order of codes inside."""
    home = shard_of(codes, depth, shards)
    order = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[order], np.arange(shards + 1))
    yield from ((k, order[cuts[k] : cuts[k + 1]]) for k in range(shards) if cuts[k + 1] > cuts[k])


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def gathered(docs: DataFrame) -> DataFrame:
    """Counts over all rows of docs (text, train): word, n, n_train. The word '' stands for the ends of texts."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed(train: Counter, other: Counter) -> Iterator[pa.RecordBatch]:
            keys = list(dict.fromkeys([*train, *other]))
            for k in range(0, len(keys), 50_000):
                own = keys[k : k + 50_000]
                arrays = [pa.array(own, pa.binary()), pa.array([train[w] + other[w] for w in own], pa.int64()), pa.array([train[w] for w in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["word", "n", "n_train"])
            train.clear()
            other.clear()

        train, other = Counter(), Counter()
        for batch in slices_of(batches):
            for text, used in zip(batch.column("text"), batch.column("train").to_pylist(), strict=True):
                (train if used else other).update([*words_of((text.as_py() or "").encode()), b""])
                if len(train) + len(other) > HELD_WORDS:
                    yield from flushed(train, other)
        yield from flushed(train, other)

    parts = docs.mapInArrow(run, "word binary, n long, n_train long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_train").alias("n_train"))


# --- context-tree weighting --------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: Stirling's series above 8, the recurrence below."""
    low = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        low += np.where(small, np.log(np.where(small, y, 1)), 0)
        y += small
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - low


HALVES, WHOLES = (np.array([math.lgamma(i + x) for i in range(1 << 16)]) for x in (0.5, 1.0))


def _gammas(n: np.ndarray, held: np.ndarray, more: float) -> np.ndarray:
    out = held[np.minimum(n, len(held) - 1)]
    large = np.flatnonzero(n >= len(held))
    out[large] = log_gamma(n[large] + more)
    return out


def block_kt(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return _gammas(zero, HALVES, 0.5) + _gammas(one, HALVES, 0.5) - 2 * HALVES[0] - _gammas(zero + one, WHOLES, 1.0)


def next_one(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (one + 0.5) / (zero + one + 1)


def mixed(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log weighted probability and weight of the own estimate."""
    both = np.logaddexp(own, below)
    return both - math.log(2), np.exp(own - both)


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    key, at = np.unique(key, return_inverse=True)
    return key, *(np.bincount(at, weights=v, minlength=len(key)).astype(v.dtype) for v in values)


class Tree:
    """Nodes of whole subtrees below contexts of over TOP bytes, from sorted numbers and their counts (zero for numbers that are only asked for)."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, depth: int):
        self.depth, self.code, self.n, self.up, self.seen = depth, {depth: codes}, {depth: n}, {}, {}
        for d in range(depth - 1, -1, -1):  # the farthest byte of the context is left out
            key = self.code[d + 1] >> np.uint64(16) << np.uint64(8) | self.code[d + 1] & np.uint64(255)
            self.code[d], self.up[d + 1] = np.unique(key, return_inverse=True)
            self.n[d] = np.bincount(self.up[d + 1], weights=self.n[d + 1], minlength=len(self.code[d])).astype(np.int64)
        for d in range(TOP + 1, depth + 1):
            context = self.code[d] >> np.uint64(8)
            new = np.append(True, context[1:] != context[:-1])
            self.seen[d] = (np.add.reduceat(self.n[d], np.flatnonzero(new)) > 0)[np.cumsum(new) - 1]

    def groups(self, d: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of a depth whose bit is the j-th: first number of each, node of each number."""
        key = self.code[d] >> np.uint64(8 - j)
        new = np.append(True, key[1:] != key[:-1])
        return np.flatnonzero(new), np.cumsum(new) - 1

    def bits(self, d: int, j: int) -> np.ndarray:
        return (self.code[d] >> np.uint64(7 - j) & np.uint64(1)).astype(bool)

    def counts(self, d: int, j: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = np.add.reduceat(np.where(self.bits(d, j), self.n[d], 0), first)
        return np.add.reduceat(self.n[d], first) - one, one

    def keys(self, d: int, j: int, first: np.ndarray) -> np.ndarray:
        """Context and inner node of the byte's decision tree."""
        code = self.code[d][first]
        return code >> np.uint64(8) << np.uint64(8) | np.uint64(1 << j) | (code & np.uint64(255)) >> np.uint64(8 - j)

    def upward(self, j: int) -> tuple[dict[int, tuple[np.ndarray, ...]], np.ndarray]:
        """By depth over TOP: node of each number, estimate, weight of it; and at TOP the sums of what lies below."""
        out, below, (first, group) = {}, None, self.groups(self.depth, j)
        for d in range(self.depth, TOP, -1):
            zero, one = self.counts(d, j, first)
            own = block_kt(zero, one)
            weighted, stop = (own, np.ones_like(own)) if below is None else mixed(own, below)
            out[d] = group, next_one(zero, one), stop
            above, group = self.groups(d - 1, j)
            below = np.bincount(group[self.up[d][first]], weights=weighted, minlength=len(above))
            first = above
        return out, below

    def tops(self) -> tuple[np.ndarray, ...]:
        """Nodes of depth TOP: key, zeros, ones, sum of the log weighted probabilities of the children here."""
        parts = []
        for j in range(8):
            first, _ = self.groups(TOP, j)
            parts.append((self.keys(TOP, j, first), *self.counts(TOP, j, first), self.upward(j)[1]))
        return tuple(map(np.concatenate, zip(*parts, strict=True)))

    def logs(self, top: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        """log10 of the probability of each number's byte in its context, rounded down.

        An estimate whose deeper node was never seen gives the weight left to the deepest node that was.
        """
        out = np.zeros(len(self.code[self.depth]))
        for j in range(8):
            deep, _ = self.upward(j)
            total, left, last = np.zeros(1), np.ones(1), np.full(1, 0.5)
            for d in range(self.depth + 1):
                at = self.up[d] if d else np.zeros(len(self.code[0]), np.int64)
                total, left, last = total[at], left[at], last[at]
                if d > TOP:
                    (group, one, stop), seen = deep[d], self.seen[d]
                else:
                    first, group = self.groups(d, j)
                    one, stop = looked_up(top[d], self.keys(d, j, first))
                    seen = np.isin(self.code[d] >> np.uint64(8), top[d][3])
                one, stop = one[group], stop[group]
                total = np.where(seen, total + left * stop * one, total)
                left = np.where(seen, left * (1 - stop), left)
                last = np.where(seen, one, last)
            chance = total + left * last
            out += np.log10(np.where(self.bits(self.depth, j), chance, 1 - chance))
        single = out.astype("<f4")
        return np.where(single > out, np.nextafter(single, np.float32(-np.inf)), single)


def looked_up(level: tuple[np.ndarray, ...], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimate and its weight; a node that no count reached has the prior's, and half the weight."""
    keys, one, stop, _ = level
    if not len(keys):
        return np.full(len(key), 0.5), np.full(len(key), 0.5)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    found = keys[at] == key
    return np.where(found, one[at], 0.5), np.where(found, stop[at], 0.5)


def upper(key: np.ndarray, zero: np.ndarray, one: np.ndarray, below: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """By depth to TOP: keys, estimates, their weights, contexts seen."""
    out: list[tuple[np.ndarray, ...]] = []
    for _ in range(TOP + 1):
        key, zero, one, below = summed(key, zero, one, below)
        weighted, stop = mixed(block_kt(zero, one), below)
        out.append((key, next_one(zero, one), stop, np.unique(key >> np.uint64(8))))
        key, below = key >> np.uint64(16) << np.uint64(8) | key & np.uint64(255), weighted
    return out[::-1]


def subtrees(codes: np.ndarray, n: np.ndarray, depth: int) -> Iterator[tuple[int, int, Tree]]:
    """(from, to, tree) of about TREE_CODES numbers at once; a context of TOP + 1 bytes stays whole."""
    context = codes >> np.uint64(8 * (depth - TOP))
    edge = np.append(np.flatnonzero(np.append(True, context[1:] != context[:-1])), len(codes))
    lo = 0
    while lo < len(codes):
        hi = int(edge[max(np.searchsorted(edge, lo + TREE_CODES, "right") - 1, np.searchsorted(edge, lo, "right"))])
        yield lo, hi, Tree(codes[lo:hi], n[lo:hi], depth)
        lo = hi


def _batch(kinds: list, names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def counted_codes(docs: DataFrame, depth: int, shards: int) -> DataFrame:
    """(shard, n, codes, counts): packed numbers of the training texts and their counts; rows of shard -1: (n, codes, counts, below, ones) of nodes of depth TOP."""
    names, kinds = ["shard", "n", "codes", "counts"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counted()

        def flushed() -> Iterator[pa.RecordBatch]:
            codes, n = held.all()
            for k, own in dealt(codes, depth, shards):
                yield _batch(kinds, names, [(k, len(own), packed(steps(codes[own])), packed(n[own]))])

        for batch in slices_of(batches):
            texts = [(x.as_py() or "").encode() for x in batch.column("text")]
            for lo, hi in blocks(texts, BLOCK):
                for _, _, code, _ in Coded(texts[lo:hi], depth).pieces():
                    if len(code):
                        held.add(*distinct(code))
                if held.parts and len(held.parts[0][0]) > HELD_CODES:
                    yield from flushed()
                    held = Counted()
        yield from flushed()

    @tidy
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in by_key(batches, "shard"):
            held = Counted()
            for _, n, codes, counts in rows:
                held.add(np.cumsum(unpacked(codes, n), dtype=np.uint64), unpacked(counts, n).astype(np.int64))
            codes, counts = held.all()
            for lo, hi, tree in subtrees(codes, counts, depth):
                key, zero, one, below = tree.tops()
                yield _batch([*kinds, pa.binary(), pa.binary()], [*names, "ones", "below"], [
                    (shard, hi - lo, packed(steps(codes[lo:hi])), packed(counts[lo:hi]), None, None),
                    (-1, len(key), packed(key), packed(zero), packed(one), below.astype("<f8").tobytes()),
                ])

    parts = docs.mapInArrow(run, "shard int, n long, codes binary, counts binary")
    return parts.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(merge, "shard int, n long, codes binary, counts binary, ones binary, below binary")


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Rows of sorted batches as tuples, by the value of a column."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            columns = [batch.column(c) for c in batch.schema.names if c != key]
            for k, *row in zip(batch.column(key), *columns, strict=True):
                yield k.as_py(), *(x.as_py() for x in row)

    return itertools.groupby(rows(), operator.itemgetter(0))


def upper_tree(stored: DataFrame) -> list[tuple[np.ndarray, ...]]:
    """The depths to TOP, from the shards' sums."""
    own: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    for r in stored.filter("shard = -1").select("n", "codes", "counts", "ones", "below").toLocalIterator():
        key, zero, one = (unpacked(r[c], r["n"]) for c in ("codes", "counts", "ones"))
        got = key, zero.astype(np.int64), one.astype(np.int64), np.frombuffer(r["below"], "<f8")
        own = list(summed(*(np.concatenate(x) for x in zip(own, got, strict=True))))
    return upper(*own)


def chunked(docs: DataFrame) -> DataFrame:
    """(chunk, ids, texts, sizes) of docs (doc_id, text): about CHUNK_BYTES of text in a row, compressed."""
    names = ["chunk", "ids", "texts", "sizes"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, size, key = [], [], 0, TaskContext.get().partitionId() << 33

        def row() -> pa.RecordBatch:
            ids = pa.chunked_array(held).combine_chunks()
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            columns = [pa.array([key], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([pa.compress(b"".join(texts), "zstd", asbytes=True)], pa.binary()), pa.array([packed(sizes)], pa.binary())], names)

        for batch in slices_of(batches):
            own = [(x.as_py() or "").encode() for x in batch.column("text")]
            for lo, hi in blocks(own, BLOCK):
                held.append(batch.column("doc_id").slice(lo, hi - lo))
                texts += own[lo:hi]
                size += sum(map(len, own[lo:hi]))
                if size >= most:
                    yield row()
                    held, texts, size, key = [], [], 0, key + 1
        if texts:
            yield row()

    most = CHUNK_BYTES
    return docs.select("doc_id", "text").mapInArrow(run, f"chunk long, ids array<{docs.schema['doc_id'].dataType.simpleString()}>, texts binary, sizes binary")


def numbered(spark: SparkSession, chunks: DataFrame) -> tuple[DataFrame, int]:
    """Chunks numbered without gaps, so that each is dealt to a task of its own; and their number. The driver gets a row for each task that made some."""
    task, last = F.shiftright("chunk", 33), F.col("chunk").bitwiseAND((1 << 33) - 1)
    made = sorted((r["task"], r["n"]) for r in chunks.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect())
    ends = list(itertools.accumulate(n for _, n in made))
    first = spark.createDataFrame([(t, e - n) for (t, n), e in zip(made, ends, strict=True)], "task long, first long")
    named = chunks.withColumn("task", task).join(F.broadcast(first), "task").withColumn("chunk", F.col("first") + last)
    return named.select("chunk", "ids", "texts", "sizes"), sum(n for _, n in made)


def texts_of(texts: bytes, sizes: bytes, n: int) -> list[bytes]:
    ends = np.cumsum(unpacked(sizes, n).astype(np.int64)).tolist()
    whole = pa.decompress(texts, ends[-1], "zstd", asbytes=True) if ends[-1] else b""
    return [whole[a:b] for a, b in itertools.pairwise([0, *ends])]


def answers(chunks: DataFrame, stored: DataFrame, top, depth: int, shards: int) -> DataFrame:
    """(chunk, shard, n, codes, logs) of the different numbers of each of the chunks."""
    names, kinds = ["shard", "chunk", "n", "codes", "counts"], [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    @tidy
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, n, *row in zip(*(batch.column(c) for c in ("chunk", "n", "texts", "sizes")), strict=True):
                codes = asked(texts_of(*(x.as_py() for x in row), n.as_py()), depth)
                for k, own in dealt(codes, depth, shards):
                    yield _batch(kinds, names, [(k, chunk.as_py(), len(own), packed(steps(codes[own])), None)])

    @tidy
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in by_key(batches, "shard"):
            held, wanted = Counted(), []
            for _, chunk, n, codes, counts in rows:  # the shard's own come first
                own = np.cumsum(unpacked(codes, n), dtype=np.uint64)
                held.add(own, np.zeros(n, np.int64) if counts is None else unpacked(counts, n).astype(np.int64))
                if counts is None:
                    wanted.append((chunk, n, codes))
            codes, counts = held.all()
            logs = np.empty(len(codes), "<f4")
            for lo, hi, tree in subtrees(codes, counts, depth):
                logs[lo:hi] = tree.logs(top.value)
            for chunk, n, own in wanted:
                found = logs[np.searchsorted(codes, np.cumsum(unpacked(own, n), dtype=np.uint64))]
                yield _batch([pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()], ["chunk", "shard", "n", "codes", "logs"], [(chunk, shard, n, own, found.tobytes())])

    wanted = chunks.select("chunk", F.size("ids").cast("long").alias("n"), "texts", "sizes").mapInArrow(ask, "shard int, chunk long, n long, codes binary, counts binary")
    known = stored.filter("shard >= 0").select("shard", F.lit(-1).cast("long").alias("chunk"), "n", "codes", "counts")
    both = wanted.unionByName(known).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "chunk")
    return both.mapInArrow(answer, "chunk long, shard int, n long, codes binary, logs binary")


def asked(texts: list[bytes], depth: int) -> np.ndarray:
    """The different numbers of some texts, sorted."""
    held, size = [np.zeros(0, np.uint64)], 0
    for lo, hi in blocks(texts, BLOCK):
        for _, _, code, _ in Coded(texts[lo:hi], depth).pieces():
            if len(code):
                held.append(distinct(code)[0])
                size += len(held[-1])
            if size > max(HELD_CODES, len(held[0])):
                held, size = [distinct(np.concatenate(held))[0]], 0
    return distinct(np.concatenate(held))[0] if size else held[0]


def chunk_scores(texts: list[bytes], got: list[tuple[int, bytes, bytes]], depth: int) -> list[float]:
    """log10 probability of each text, from the shards' answers (n, codes, logs)."""
    codes = np.concatenate([np.cumsum(unpacked(x, n), dtype=np.uint64) for n, x, _ in got])
    order = np.argsort(codes)
    codes, logs = codes[order], np.concatenate([np.frombuffer(x, "<f4") for _, _, x in got])[order]
    del order
    return [x for lo, hi in blocks(texts, BLOCK) for x in Coded(texts[lo:hi], depth).sums(codes, logs)]


# --- scoring -------------------------------------------------------------------------------------


def least_count(words: DataFrame) -> int:
    """The least power of two such that at most FREQUENT words have that count; the driver gets one row for each power."""
    power = F.floor(F.log2("n")).cast("int")
    sizes = {r["p"]: r["words"] for r in words.groupBy(power.alias("p")).agg(F.count("*").alias("words")).collect()}
    total, least = 0, max(sizes, default=0) + 1
    for p in sorted(sizes, reverse=True):
        total += sizes[p]
        if total > FREQUENT:
            break
        least = p
    return 1 << least


def score_documents(docs: DataFrame, train, depth: int = TOP + 1) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row of docs; train: a condition on its rows; depth: bytes of context, 3 to 7 (the query takes DEPTH)."""
    if not TOP < depth < 8:
        raise ValueError(f"depth {depth} is not from {TOP + 1} to 7")
    spark = docs.sparkSession
    flagged = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    seen = written(spark, gathered(flagged.select("text", "train")), "lm-counts")
    known, total = seen.agg(F.count(F.when(F.col("n_train") > 0, 1)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    log_all = math.log10((total + 1 * (known + 1)) or 1)
    short = seen.filter(F.length("word") <= FREQUENT_BYTES)
    frequent = short.filter(F.col("n") >= least_count(short)).select("word", "n_train").toArrow()
    held = spark.sparkContext.broadcast(dict(zip(frequent["word"].to_pylist(), frequent["n_train"].to_pylist(), strict=True)))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    shards = max(1, -(-size // SHARD_BYTES))
    stored = written(spark, counted_codes(flagged.filter("train").select("text"), depth, shards), "lm-codes")
    top = spark.sparkContext.broadcast(upper_tree(stored))
    chunks, n_chunks = numbered(spark, written(spark, chunked(docs), "lm-docs"))
    logs = answers(chunks, stored, top, depth, shards)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = itertools.count(TaskContext.get().partitionId() << 33)
        for _, rows in by_key(batches, "chunk"):
            _, _, ids, texts, sizes, *_ = next(rows)  # the documents come first, then the answers
            yield from scored(pa.array(ids, id_arrow), texts_of(texts, sizes, len(ids)), [r[-3:] for r in rows], key)

    def scored(ids: pa.Array, texts: list[bytes], got: list[tuple], key: Iterator[int]) -> Iterator[pa.RecordBatch]:
        scores = chunk_scores(texts, got, depth)
        find = held.value.get
        rare_type = pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int32())]))
        for a in range(0, len(texts), 1000):
            own, points = texts[a : a + 1000], scores[a : a + 1000]
            keys, n_tokens, n_known, base, rare, tfs, offsets = [], [], [], [], [], [], [0]
            for text in own:
                split = [*words_of(text), b""]
                hit, sum_, other = 0, 0.0, Counter()
                for c, w in zip(map(find, split), split, strict=True):
                    if c is None:
                        other[w] += 1
                    else:
                        hit += c > 0
                        sum_ += LOG[c] if c < len(LOG) else math.log10(c + 1)
                keys.append(next(key))
                n_tokens.append(len(split))
                n_known.append(hit)
                base.append(sum_)
                rare += other
                tfs += other.values()
                offsets.append(len(rare))
            structs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(tfs, pa.int32())], ["word", "tf"])
            bits = [-s / LOG2 / (len(t) + 1) for s, t in zip(points, own, strict=True)]
            arrays = [pa.array(keys, pa.int64()), ids.slice(a, len(own)), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(points, pa.float64()), pa.array(bits, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs).cast(rare_type)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "doc_id", "n_tokens", "n_known", "logs", "score", "bits_per_byte", "rare"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    id_arrow = to_arrow_type(docs.schema["doc_id"].dataType)
    asking = chunks.select("chunk", F.lit(-1).alias("shard"), "ids", "texts", "sizes", F.lit(None).cast("long").alias("n"), *(F.lit(None).cast("binary").alias(c) for c in ("codes", "logs")))
    both = asking.unionByName(logs, allowMissingColumns=True).repartitionById(max(1, n_chunks), F.col("chunk").cast("int")).sortWithinPartitions("chunk", "shard")
    rows = both.mapInArrow(run, f"key long, doc_id {id_type}, n_tokens long, n_known long, logs double, score double, bits_per_byte double, rare array<struct<word:binary,tf:int>>")
    rows = written(spark, rows, "lm-rows")
    rare = rows.select("key", F.explode("rare").alias("r")).select("key", F.col("r.word").alias("word"), F.col("r.tf").alias("tf"))
    rest = seen.filter("n_train > 0").select("word", F.col("n_train").alias("c"))
    more = rare.join(rest, "word").groupBy("key").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("more"), F.sum(F.col("tf").cast("long")).alias("more_known"))
    out = rows.drop("rare").join(more, "key", "left")
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(log_all)).alias("base_score"), "score", "bits_per_byte",
    )


LOG2 = math.log10(2)
LOG = np.log10(np.arange(1, 100_001)).tolist()


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = score_documents(table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2, DEPTH)
    return got.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
