"""Benchmark decontamination by training suffix arrays.

Every task holds shards of the training texts: the word suffixes of a block of documents, sorted. A suffix can
match a test window only if its first words all occur in the test set, so only those suffixes enter the shard's array (no
match is lost). Every suffix of a test item that begins with a window is binary-searched in each shard (equal windows together); the range found gives
the places of all verbatim matches. Where a match begins, the longest common prefix of the test suffix and the training suffix
is its length, and the longest one is told with its places. Documents never move: one map, no shuffle.

The test set is broadcast in slices of about ``SLICE_BYTES`` of text, of which a worker holds one at a time; a test set of more than ``MOST_TEST_BYTES``
is refused (calls for parts of it can follow one another), which bounds what is broadcast. Words are compared by a 64-bit hash.

Null text has no words. Items without words have no window. Repeated items count by their distinct item_id; rows that
repeat are judged alike. Empty tables give no rows, or rows without hits. Extra columns are ignored by ``overlaps`` and kept
by ``clean_documents``. Texts of any length are handled in blocks of whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _P, ALNUM, Words, _powers, blocks, mix, slices_of, table, tidy

WINDOW = 10
SLICE_BYTES, MOST_TEST_BYTES = 32 << 20, 1 << 30
#: Pairs of a test and a training suffix whose common prefixes are measured at once.
PAIRS = 1 << 18


def keys_of(ids: np.ndarray, place: np.ndarray, size: np.ndarray, window: int, fill: int = 0) -> np.ndarray:
    """The first ``window`` words from each place as one comparable string; what lies beyond size is filled with a byte."""
    keys = np.full((len(place), window), fill * 0x01010101, ">u4")
    for k in range(window):
        live = size > k
        keys[live, k] = ids[place[live] + k]
    return keys.view(f"S{4 * window}").ravel()


class Prefixes:
    """Hashes of any range of a string of word ids."""

    def __init__(self, ids: np.ndarray):
        power, base = _powers(len(ids) + 1, _P), np.uint64(pow(int(_P), -1, 1 << 64))
        self.run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)))
        self.inverse = _powers(len(ids) + 1, base)

    def of(self, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.run[lo + size] - self.run[lo]) * self.inverse[lo]


class TestSlice:
    """The suffixes of some test items that begin with a window (or are a whole shorter item), in order of their windows."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        words = Words([text for _, text in items], ALNUM)
        self.names = [name for name, _ in items]
        many = np.diff(words.first)
        self.vocabulary = np.unique(words.hash)
        self.ids = (np.searchsorted(self.vocabulary, words.hash) + 1).astype(np.uint32)
        self.item = np.repeat(np.arange(len(items)), many)
        self.at = np.arange(len(self.ids)) - words.first[self.item]
        self.left = many[self.item] - self.at
        begin = np.flatnonzero((self.left >= window) | (self.at == 0))
        size = np.minimum(self.left[begin], window)
        keys = keys_of(self.ids, begin, size, window)
        order = np.argsort(keys, kind="stable")
        self.suffixes, new = begin[order], np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(order) else order
        self.cuts = np.append(new, len(order))
        first = order[new]
        self.sizes, self.low, self.high = size[first], keys[first], keys_of(self.ids, begin[first], size[first], window, 0xFF)
        self.least = int(size.min()) if len(size) else 0
        self.prefixes = Prefixes(self.ids)


class Shard:
    """A suffix array of a block of texts over the words that a slice knows."""

    def __init__(self, words: Words, doc_of: np.ndarray, test: TestSlice, window: int):
        n = len(words.hash)
        at = np.searchsorted(test.vocabulary, words.hash)
        at[at == len(test.vocabulary)] = 0
        known = test.vocabulary[at] == words.hash
        self.ids = np.where(known, at + 1, 0).astype(np.uint32)
        # how many known words of the same text follow, this one included
        stop = np.flatnonzero(~known | np.append(doc_of[1:] != doc_of[:-1], True)) if n else np.zeros(0, np.int64)
        reach = stop[np.searchsorted(stop, np.arange(n))] if n else stop
        self.left = reach - np.arange(n) + known[reach] if n else reach
        place = np.flatnonzero(self.left >= test.least) if n else stop
        keys = keys_of(self.ids, place, self.left[place], window)
        order = np.argsort(keys, kind="stable")
        self.suffixes, self.keys = place[order], keys[order]

    def found(self, test: TestSlice) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of every occurrence: each window's suffixes lie between two binary searches."""
        low, high = np.searchsorted(self.keys, test.low, "left"), np.searchsorted(self.keys, test.high, "right")
        hit = np.flatnonzero(high > low)
        return np.repeat(hit, (high - low)[hit]), self.suffixes[ranges(low[hit], (high - low)[hit])]

    def matches(self, test: TestSlice, window: np.ndarray, place: np.ndarray, doc_of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, test suffix, words) of every maximal verbatim match, in pieces of bounded size."""
        many = np.diff(test.cuts)[window]
        upto = np.cumsum(many)
        prefixes = Prefixes(self.ids) if len(place) else None
        lo = 0
        while lo < len(place):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - many[lo] + PAIRS, "right")))
            s, p = test.suffixes[ranges(test.cuts[window[lo:hi]], many[lo:hi])], np.repeat(place[lo:hi], many[lo:hi])
            starts = (test.at[s] == 0) | (p == 0) | (doc_of[p - 1] != doc_of[p]) | (test.ids[s - 1] != self.ids[p - 1])
            s, p = s[starts], p[starts]
            least, most = np.ones(len(s), np.int64), np.minimum(test.left[s], self.left[p])
            while (open_ := least < most).any():  # the longest common prefix, by halves
                half = (least + most + 1) // 2
                same = open_ & (test.prefixes.of(s, half) == prefixes.of(p, half))
                least, most = np.where(same, half, least), np.where(open_ & ~same, half - 1, most)
            yield p, s, least
            lo = hi


def ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... many[0] numbers, then those of start[1], and so on."""
    return np.repeat(start - np.cumsum(many) + many, many) + np.arange(int(many.sum()))


def slices(spark: SparkSession, benchmark: DataFrame, window: int, most: int) -> list:
    """Broadcasts of the test set; the driver holds one slice at a time."""
    out, held, size = [], [], 0
    texts = benchmark.select(F.col("item_id").cast("string"), "text").filter("text is not null")
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if total > MOST_TEST_BYTES:
        raise ValueError(f"a test set of {total} bytes is beyond the {MOST_TEST_BYTES} that are broadcast: call once for each part of it")
    for item, text in texts.toLocalIterator():
        held.append((item or "", text.encode().lower()))
        size += len(text)
        if size > most:
            out.append(spark.sparkContext.broadcast(TestSlice(held, window)))
            held, size = [], 0
    return [*out, spark.sparkContext.broadcast(TestSlice(held, window))] if held else out


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES, carry: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; of the longest verbatim match with one item (the first of
    equal ones by place, then by item): longest (words), longest_at (its first word), longest_item, longest_item_at.

    carry: all columns of docs instead, of the rows that are not contaminated.
    """
    tests = slices(docs.sparkSession, benchmark, window, slice_bytes)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_at", "longest_item", "longest_item_at"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches):
            texts = [(x.as_py() or "").encode().lower() for x in batch.column("text")]
            out = [row for lo, hi in blocks(texts, (2 if len(tests) < 2 else 16) << 20) for row in judge(texts[lo:hi], tests, window, not carry)]
            if carry:
                yield batch.filter(pa.array([not row[1] for row in out], pa.bool_()))
                continue
            n_words, n_hit, items, longest = zip(*out, strict=True) if out else ([], [], [], [])
            shas = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
            best = [(-a, b, c, d) for a, b, c, d in longest]
            arrays = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(map(len, items), pa.int64()), pa.array(shas, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())]
            arrays += [pa.array([x[k] for x in best], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names)

    if carry:
        return docs.mapInArrow(run, docs.schema)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_at long, longest_item string, longest_item_at long")


def judge(texts: list[bytes], tests: list, window: int, longest: bool = True) -> list[tuple]:
    """Of each text: number of words, of words hit, names of the items hit, and (-words, place, item, place in the item) of the longest match."""
    words = Words(texts, ALNUM)
    n = len(words.hash)
    per_doc = np.diff(words.first)
    doc_of = np.repeat(np.arange(len(texts)), per_doc)
    cover = np.zeros(n + 1, np.int64)
    items: list[set[str]] = [set() for _ in texts]
    best: list[tuple] = [(0, -1, None, -1)] * len(texts)
    for held in tests:
        test = held.value
        if len(tests) > 1:  # one slice at a time stays in memory
            held.__dict__.pop("_value", None)
        shard = Shard(words, doc_of, test, window)
        which, place = shard.found(test)
        if not len(place):
            continue
        np.add.at(cover, place, 1)
        np.add.at(cover, place + test.sizes[which], -1)
        told = np.unique(doc_of[place] * np.int64(len(test.sizes)) + which)
        for d, w in zip((told // len(test.sizes)).tolist(), (told % len(test.sizes)).tolist(), strict=True):
            items[d].update(test.names[k] for k in np.unique(test.item[test.suffixes[test.cuts[w] : test.cuts[w + 1]]]))
        for p, s, size in shard.matches(test, which, place, doc_of) if longest else ():
            home, at = doc_of[p], p - words.first[doc_of[p]]
            most = np.zeros(len(texts), np.int64)
            np.maximum.at(most, home, size)
            for k in np.flatnonzero(size == most[home]):
                best[home[k]] = min(best[home[k]], (-int(size[k]), int(at[k]), test.names[test.item[s[k]]], int(test.at[s[k]])))
    hit = np.cumsum(cover[:-1]) > 0
    total = np.concatenate(([0], np.cumsum(hit)))
    n_hit = total[words.first[1:]] - total[words.first[:-1]]
    return [(int(per_doc[d]), int(n_hit[d]), items[d], best[d]) for d in range(len(texts))]


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without a hit, with all their columns."""
    return overlaps(docs, benchmark, window, carry=True)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
