"""Suffix-array dedup: removes every byte covered by a 200-byte string that also starts anywhere else.

All suffixes of a large corpus cannot be sorted in one place, so strings are dealt to shards first, such that equal strings meet:
the anchor of a 200-byte string is the place of its least 32-gram hash (the last such place), which depends on the string only. Every
string belongs to one anchor; neighbouring strings of one anchor share a context, the bytes that they cover together. Anchors
whose 32-gram occurs once in the corpus hold no repeated string and go no further (a Bloom filter of the repeated ones, so none is
lost). The other contexts are dealt by their 32-gram; equal contexts of a task are sent once, with a mark.

A 32-gram of very many occurrences is split exactly, by the distance from a string's start to it and the bytes that all strings at such distances share.

A shard's contexts stream into a scratch and are sorted there by external induction (``induced``: queues of suffix tuples that carry
common prefixes; text, types, order and prefixes lie on disk beyond a bound in memory), so a shard may be larger than the
memory. A string is repeated if the common prefix with a neighbour in the order has 200 bytes. Places go back to their documents, which join by a key.

Null text is empty. Texts under 200 bytes keep everything. Repeated rows are documents of their own (and repeat each other). Ties do
not exist: all occurrences of a repeated string go, the first one too, as judged on the input. An empty table gives no rows. Extra columns
are ignored. A document's key is a 128-bit hash of doc_id and text; rows that agree in both share it, and their marks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import induced
from .common import _CODE, blocks, hashed_table, hot_lookup, mix, slices_of, table, text_of, written

WIDTH, GRAM = 200, 32
SPAN = WIDTH - GRAM + 1  # 32-grams in a string
SHARD_BYTES, ROWS_A_BUCKET = 4 << 20, 500_000
LEAST_BITS, MOST_BITS = 20, 30
#: A 32-gram of more occurrences is hot (so few are that they are broadcast); its strings are split by their distance to it, in ranges of STEP.
HOT_ROWS, MOST_HOT, STEP = 20_000, 1 << 20, 21


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place, by doubling."""
    h, size = _CODE[data], 1
    while size < GRAM:
        h = h[:-size] * np.uint64(0x9E3779B97F4A7C15) + h[size:] * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        size *= 2
    return h


def least_places(h: np.ndarray, most: int = 1 << 24) -> np.ndarray:
    """For every window of SPAN hashes, the place of the least (of 40 bits), the last of equals. A place has 24 bits, so that longer arrays are cut into overlapping pieces of ``most``."""
    n = len(h)
    if n > most:
        step = most - SPAN + 1
        return np.concatenate([at + least_places(h[at : at + most], most) for at in range(0, n - SPAN + 1, step)])
    key = (h >> np.uint64(24) << np.uint64(24)) | (np.uint64((1 << 24) - 1) - np.arange(n, dtype=np.uint64))
    pad = -n % SPAN
    grid = np.append(key, np.full(pad, ~np.uint64(0))).reshape(-1, SPAN)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()[:n]
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    least = np.minimum(behind[: n - SPAN + 1], ahead[SPAN - 1 :])
    return ((1 << 24) - 1) - (least & np.uint64((1 << 24) - 1)).astype(np.int64)


class Contexts:
    """Contexts of the strings of some texts: gram (hash), doc, first string's start in the text, number of strings; data, at (place in data) and anchor (likewise)."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        base = np.cumsum(sizes + 1) - sizes - 1
        if len(self.data) < WIDTH or sizes.max() < WIDTH:
            self.gram, self.doc, self.start, self.many, self.at, self.anchor = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(5))
            return
        h = gram_hashes(self.data)
        place = least_places(h)  # by start of the string
        change = np.zeros(len(place), bool)
        change[0] = True
        change[1:] = place[1:] != place[:-1]
        change[base[base < len(place)]] = True
        stop = base + np.maximum(sizes - WIDTH + 1, 0)  # strings of a text start before this
        change[stop[stop < len(place)]] = True
        at = np.flatnonzero(change)
        end = np.append(at[1:], len(place))
        doc = np.searchsorted(base, at, "right") - 1
        live = at < stop[doc]
        self.at, self.doc = at[live], doc[live]
        self.anchor = place[self.at]
        self.start, self.many, self.gram = self.at - base[self.doc], (end - at)[live], mix(h[self.anchor])


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x.as_py().encode() for x in batch.column("text")]


def _cut(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    yield from ((k, order[cuts[k] : cuts[k + 1]]) for k in range(buckets) if cuts[k + 1] > cuts[k])


def repeated_grams(docs: DataFrame, buckets: int) -> DataFrame:
    """(grams, n, often, most): anchors' 32-grams that occur more than once, packed by bucket; their occurrences; those of over HOT_ROWS with their numbers, and the largest number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            g, n = np.unique(np.concatenate(held), return_counts=True)
            parts = list(_cut((g % np.uint64(buckets)).astype(np.int64), buckets))
            arrays = [pa.array([k for k, _ in parts], pa.int32()), pa.array([g[o].tobytes() for _, o in parts], pa.binary()), pa.array([n[o].astype("<i4").tobytes() for _, o in parts], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["bucket", "grams", "counts"])

        for batch in slices_of(batches):
            texts = _texts(batch)
            for lo, hi in blocks(texts, 2 << 20):
                held.append(Contexts(texts[lo:hi]).gram)
            if sum(map(len, held)) > 1_000_000:
                yield flush()
                held.clear()
        if sum(map(len, held)):
            yield flush()

    def count(part: pd.DataFrame) -> pd.DataFrame:
        g = np.concatenate([np.frombuffer(x, np.uint64) for x in part["grams"]])
        n = np.concatenate([np.frombuffer(x, "<i4") for x in part["counts"]]).astype(np.int64)
        order = np.argsort(g)
        g, n = g[order], n[order]
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        total = np.add.reduceat(n, first)
        many = g[first][total > 1]
        hot = total > HOT_ROWS
        often = np.stack([g[first][hot], total[hot].astype(np.uint64)], axis=1)
        return pd.DataFrame({"grams": [many.tobytes()], "n": [int(total[total > 1].sum())], "often": [often.tobytes()], "most": [int(total.max())]})

    return docs.select("text").mapInArrow(run, "bucket int, grams binary, counts binary").groupBy("bucket").applyInPandas(count, "grams binary, n long, often binary, most long")


def bloom_filter(packed: DataFrame, bits: int) -> np.ndarray:
    """A filter of 2**bits bits, two probes, over packed 64-bit numbers."""

    def entries(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for x in batch.column("grams"):
            at = np.unique(np.concatenate(probes(np.frombuffer(x.as_buffer(), np.uint64), bits)))
            yield at, np.ones(len(at), np.uint8)

    return hashed_table(packed.select("grams"), bits, entries, packed=True)


def probes(g: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(g)
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def name_of(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def split_hot(gram: np.ndarray, start: np.ndarray, many: np.ndarray, at: np.ndarray, anchor: np.ndarray, hot: np.ndarray, raw: bytes) -> tuple[np.ndarray, ...]:
    """Contexts (name, row, start, many, at) in which those of a hot 32-gram are split by the distance from a string's start to the anchor.

    Strings whose distances lie in one range of ``STEP`` share the ``WIDTH - STEP + 1`` bytes around the anchor that lie in all of them, and those
    name the part: equal strings have equal distances, so they still meet, and strings that only share the 32-gram part ways.
    """
    is_hot = np.isin(gram, hot) if len(hot) else np.zeros(len(gram), bool)
    plain = np.flatnonzero(~is_hot)
    rows, names, starts, sizes, places = [plain], [gram[plain]], [start[plain]], [many[plain]], [at[plain]]
    for i in np.flatnonzero(is_hot).tolist():
        far, near = int(anchor[i] - at[i]), int(anchor[i] - at[i] - many[i] + 1)
        for q in range(near // STEP, far // STEP + 1):
            lo, hi = int(anchor[i]) - min(far, q * STEP + STEP - 1), int(anchor[i]) - max(near, q * STEP)  # first and last string
            key = raw[int(anchor[i]) - q * STEP : int(anchor[i]) - q * STEP + WIDTH - STEP + 1]
            rows.append(np.array([i]))
            names.append(np.array([name_of(key + bytes([q]))], np.uint64))
            starts.append(np.array([start[i] + lo - at[i]]))
            sizes.append(np.array([hi - lo + 1]))
            places.append(np.array([lo]))
    return tuple(map(np.concatenate, (names, rows, starts, sizes, places)))


def sent(docs: DataFrame, bloom, bits: int, shards: int, hot) -> DataFrame:
    """Contexts by shard: keys (two numbers each), starts, strings (packed numbers), flags (known to be repeated) and data; equal contexts of a task once. Rows of shard -1 hold strings known to be repeated."""
    names = ["shard", "keys", "starts", "many", "flags", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        kept, often = bloom.value, hot.value

        def flush() -> pa.RecordBatch:
            gram, key, start, many = (np.concatenate([x[i] for x in held]) for i in range(4))
            data = [d for x in held for d in x[4]]
            of: dict[tuple[int, bytes], int] = {}
            twin = np.array([of.setdefault((int(g), d), i) for i, (g, d) in enumerate(zip(gram, data, strict=True))], np.int64)
            copies = np.bincount(twin, minlength=len(twin))
            again = copies[twin] > 1
            first = np.flatnonzero(twin == np.arange(len(twin)))
            rows = [(k, first[o]) for k, o in _cut((gram[first] % np.uint64(shards)).astype(np.int64), shards)]
            told = np.flatnonzero(again)
            cols = ([k for k, _ in rows] + [-1], [key[o].tobytes() for _, o in rows] + [key[told].tobytes()], [start[o].tobytes() for _, o in rows] + [start[told].tobytes()], [many[o].tobytes() for _, o in rows] + [many[told].tobytes()], [again[o].tobytes() for _, o in rows] + [b""], [b"".join(data[i] for i in o) for _, o in rows] + [b""])
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), *[pa.binary()] * 5), strict=True)], names)

        for batch in slices_of(batches):
            texts = _texts(batch)
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in ("key1", "key2")], axis=1)
            for lo, hi in blocks(texts, 2 << 20):
                c = Contexts(texts[lo:hi])
                if not len(c.gram):
                    continue
                a, b = probes(c.gram, bits)
                live = np.flatnonzero((kept[a >> 3] >> (7 - (a & 7)) & 1) & (kept[b >> 3] >> (7 - (b & 7)) & 1))
                raw = c.data.tobytes()
                gram, row, start, many, at = split_hot(c.gram[live], c.start[live], c.many[live], c.at[live], c.anchor[live], often, raw)
                data = [raw[p : p + m + WIDTH - 1] for p, m in zip(at.tolist(), many.tolist(), strict=True)]
                held.append((gram, keys[lo:hi][c.doc[live][row]], start, many, data))
                size += sum(map(len, data))
                if size > 24 << 20:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    return docs.select("key1", "key2", "text").mapInArrow(run, "shard int, keys binary, starts binary, many binary, flags binary, data binary")


class Gathered:
    """The contexts of one shard as they stream in: their bytes go to the scratch, some 60 bytes of each stay in memory."""

    def __init__(self):
        self.scratch = induced.Scratch()
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.data: list = []
        self.size = 0

    def add(self, keys: bytes, starts: bytes, many: bytes, flags: bytes, data: bytes) -> None:
        many = np.frombuffer(many, np.int64)
        ends = np.cumsum(many + WIDTH - 1)
        names = np.frombuffer(b"".join(hashlib.blake2b(data[e - m - WIDTH + 1 : e], digest_size=16).digest() for m, e in zip(many.tolist(), ends.tolist(), strict=True)), np.uint64).reshape(-1, 2)
        self.rows.append((np.frombuffer(keys, np.int64).reshape(-1, 2), np.frombuffer(starts, np.int64), many, np.frombuffer(flags, bool), names, np.full(len(many), len(self.data)), ends - many - WIDTH + 1))
        self.data.append(self.scratch.put(np.frombuffer(data, np.uint8)))
        self.size += len(data)

    def marks(self) -> Iterator[pa.RecordBatch]:
        """(key1, key2, lo, hi): starts lo to hi (exclusive) of repeated strings."""
        try:
            yield from self._marks()
        finally:
            self.scratch.close()

    def _marks(self) -> Iterator[pa.RecordBatch]:
        key, start, many, flag, name, block, offset = (np.concatenate([r[k] for r in self.rows]) for k in range(7))
        # equal contexts of several tasks are sorted once; all strings of such a context are repeated
        order = np.lexsort((name[:, 1], name[:, 0]))
        new = np.append(True, (name[order][1:] != name[order][:-1]).any(1))
        heads = np.flatnonzero(new)
        copies = np.diff(np.append(heads, len(order)))
        every = np.logical_or.reduceat(flag[order], heads) | (copies > 1)
        one = order[heads]
        by_place = np.lexsort((offset[one], block[one]))  # bytes are read block by block
        one, every = one[by_place], every[by_place]
        head_of = np.empty(len(order), np.int64)  # of each context: its number among the different ones
        head_of[order] = np.argsort(by_place)[np.cumsum(new) - 1]
        size = many[one] + WIDTH  # with what parts it from the next
        begin = np.cumsum(size) - size
        n = int(size.sum())
        text = self.scratch.array(n + 1, np.uint16)  # 0 ends the shard, 1 parts contexts, bytes follow
        string = self.scratch.array(n + 1, bool)  # places where a string starts
        hit = self.scratch.array(n + 1, bool)
        at = 0
        while at < len(one):
            stop = at + max(1, int(np.searchsorted(begin[at:] - begin[at], induced.BLOCK)))
            stop = min(stop, at + int(np.searchsorted(block[one[at:]], block[one[at]], "right")))
            raw = self.scratch.get(self.data[block[one[at]]], keep=True)
            own = np.arange(at, stop)
            inside = np.arange(int(size[own].sum())) - np.repeat(begin[own] - begin[at], size[own])
            last = inside == np.repeat(size[own] - 1, size[own])
            source = np.repeat(offset[one[own]], size[own]) + inside
            source[last] = 0
            lo, hi = int(begin[at]), int(begin[at]) + len(inside)
            text[lo:hi] = np.where(last, 1, raw[source].astype(np.uint16) + 2)
            string[lo:hi] = inside < np.repeat(many[one[own]], size[own])
            hit[lo:hi] = np.repeat(every[own], size[own])
            at = stop
        suffix, prefix = induced.suffixes(text, WIDTH, self.scratch, 258)
        for lo, hi in induced.blocks(n + 1):
            same = np.flatnonzero(np.asarray(prefix[lo:hi]) >= WIDTH) + lo
            hit[suffix[same]] = True
            hit[suffix[same - 1]] = True
        # runs of repeated strings; none crosses the edge of its context
        los, his = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        before = False
        for lo, hi in induced.blocks(n + 1):
            own = np.asarray(hit[lo:hi]) & np.asarray(string[lo:hi])
            edge = np.diff(own.view(np.int8), prepend=np.int8(before))
            los.append(np.flatnonzero(edge == 1) + lo)
            his.append(np.flatnonzero(edge == -1) + lo)
            before = own[-1]
        los, his = np.concatenate(los), np.concatenate(his)
        first = np.searchsorted(los, begin)
        runs = np.searchsorted(los, begin + size) - first
        for a in range(0, len(head_of), 1 << 16):
            context = np.arange(a, min(len(head_of), a + (1 << 16)))
            head = head_of[context]
            row = np.repeat(context, runs[head])
            pick = np.repeat(first[head] - np.cumsum(runs[head]) + runs[head], runs[head]) + np.arange(int(runs[head].sum()))
            shift = start[row] - begin[head_of[row]]
            yield _marked(key[row], shift + los[pick], shift + his[pick])


def _marked(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (key[:, 0], key[:, 1], lo, hi)], ["key1", "key2", "lo", "hi"])


def repeated(contexts: DataFrame, tasks: int) -> DataFrame:
    """(key1, key2, lo, hi) of repeated strings. A task gets its shards one after the other and streams each to its scratch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            for shard, *row in zip(*(batch.column(c) for c in ("shard", "keys", "starts", "many", "flags", "data")), strict=True):
                if held is not None and shard.as_py() != now:
                    yield from held.marks()
                    held = None
                now, held = shard.as_py(), held or Gathered()
                held.add(*(x.as_py() for x in row))
        if held is not None:
            yield from held.marks()

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, s, m in zip(*(batch.column(c) for c in ("keys", "starts", "many")), strict=True):
                key, start, many = (np.frombuffer(x.as_buffer(), np.int64) for x in (k, s, m))
                yield _marked(key.reshape(-1, 2), start, start + many)

    kinds = "key1 long, key2 long, lo long, hi long"
    dealt = contexts.filter("shard >= 0").repartition(tasks, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, kinds).unionByName(contexts.filter("shard = -1").select("keys", "starts", "many").mapInArrow(plain, kinds))


def kept_bytes(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of text, and the maximal removed ranges."""
    order = np.argsort(lo)
    spans: list[list[int]] = []
    for a, b in zip(lo[order].tolist(), (hi[order] + WIDTH - 1).tolist(), strict=True):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    left = b"".join(text[x:y] for x, y in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(text)], strict=True))
    return left, [(a, b) for a, b in spans]


def hot_grams(grams: DataFrame, bound: int) -> np.ndarray:
    """The 32-grams of more than bound occurrences, sorted: by arithmetic, few."""
    held = [np.frombuffer(r["often"], np.uint64) for r in grams.select("often", "most").filter(F.col("most") > bound).select("often").toLocalIterator()]
    pairs = np.concatenate([x.reshape(-1, 2) for x in held]) if held else np.zeros((0, 2), np.uint64)
    return np.sort(pairs[pairs[:, 1] > bound, 0])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept (binary), spans (removed byte ranges) of every row of docs."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_of("text").alias("text")).withColumns({"key1": F.xxhash64("doc_id", "text"), "key2": F.xxhash64("text", F.lit("2"), "doc_id")})
    chars = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    grams = written(spark, repeated_grams(rows, max(1, -(-chars // (85 * ROWS_A_BUCKET)))), "grams")
    occurs, distinct = grams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.octet_length("grams") / 8), F.lit(0))).first()
    bits = min(MOST_BITS, max(LEAST_BITS, int(16 * distinct).bit_length()))
    bloom = spark.sparkContext.broadcast(bloom_filter(grams, bits) if occurs else np.zeros(1 << (bits - 3), np.uint8))
    hot = hot_grams(grams, max(HOT_ROWS, occurs // MOST_HOT))
    shards = max(1, -(-occurs * 284 // SHARD_BYTES))
    contexts = written(spark, sent(rows, bloom, bits, shards, spark.sparkContext.broadcast(hot)), "contexts")
    # rows that agree in doc_id and text share a key and their marks; so many of them there are
    marks = repeated(contexts, max(1, -(-shards // 4))).groupBy("key1", "key2", "lo", "hi").agg(F.count("*").alias("size"))
    key = F.concat_ws(":", "key1", "key2").alias("key")
    marks = written(spark, marks.groupBy(key).agg(F.max("size").alias("size"), F.collect_list(F.struct("lo", "hi")).alias("marks")), "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches):
            n, kept, spans = [], [], []
            for text, mark in zip(batch.column("text"), batch.column("marks"), strict=True):
                text = text.as_py().encode()
                found = mark.values.flatten() if mark.is_valid else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                left, cut = kept_bytes(text, *(np.asarray(x) for x in found))
                n.append(len(text))
                kept.append(left)
                spans.append([{"lo": a, "hi": b} for a, b in cut])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))], ["doc_id", "n_bytes", "kept", "spans"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = hot_lookup(rows.select("doc_id", "text", key), "key", marks, ["marks"], "doc_id")
    return found.select("doc_id", "text", "marks").mapInArrow(run, f"doc_id {id_type}, n_bytes long, kept binary, spans array<struct<lo:long,hi:long>>")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
