"""N-gram Jaccard join: count vectors in an R-tree, over shards in which every linked pair meets.

A document is the set of its distinct five-word shingles (64-bit hashes). Its point counts the shingles by ``DIMS`` hash groups; the
overlap of two sets is at most the sum of their coordinates' minima, so a box of an R-tree whose upper corner cannot
reach the overlap that the threshold demands is skipped, and only surviving pairs are verified on their whole sets.

All points in one tree would not scale out, so shards come first. Shingles have a global order: by the level of their document
frequency, counted over all rows from 32-bit parts of the hashes in buckets, then by hash. The levels reach the tasks as a table of
bounded size with two probes, in which collisions only raise a level: alike for all, so the order stays one order. Sets
whose Jaccard index is at least t share l shingles among the first n - ceil(t * n) + l of each, or all they share. Of these leading
shingles, those of frequency one meet nothing; by the others each document goes to shards:

* shards of up to ``SMALL`` sets: every pair of sizes that fit. A pair that meets only in such shards must meet l times;
* larger shards: first each set against one hub of its shards, then, by R-tree, against the few nearest sets of other components
  (cheap rounds, which join most of a group of copies). What still lies in different components of one shard is then searched by
  R-tree without a limit. Shards over ``SHARD`` sets are dealt out in pairs of blocks.

Surviving pairs are verified in every round, and all verified links make the components. Nothing is capped: what the first rounds leave
out, the last finds. A link lies inside a component, so links are counted there afterwards, over all pairs of whole sets, by products
of incidence matrices in pairs of blocks of about ``BLOCK_BYTES``. Equal sets are one node from the start (identified by a 64-bit sum over the set), so copies cost one node.
The main data (leading shingles) move as packed arrays, once.

Null text, or text without words, has no shingles and is linked with nothing: it is its own component. A text of one to four words is
one shingle. Repeated rows are equal sets. A null doc_id takes part; its component is the smallest id of its component, or null. An
empty table gives no rows. Extra columns are ignored by ``jaccard_classes`` and kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NOT_BLANK, Words, blocks, give_back, hashed_table, hot_lookup, mix, slices_of, table, text_of, tidy, written
from .components import components

SIZE, DIMS = 5, 256
NUM, DEN = 3, 4  # the threshold 0.75
SHARED = 4  # l
SMALL, SHARD, NEAREST = 8, 8_192, 2
#: Blocks of sets whose links are counted: bytes and sets. A pair of sets that share a shingle costs as much as so many products of a dense column, of which COLUMNS are multiplied at once.
BLOCK_BYTES, BLOCK_SETS, PAIR_COST, COLUMNS = 4 << 20, 2_048, 64, 1_024
#: Document frequencies from which a level begins; shingles below the first are not sent.
LEVELS = (2, 9, 65, 513, 4097, 32_769)
LEAST_BITS, MOST_BITS = 16, 27
BLOOM_BITS = 26
ROWS_A_BUCKET, PRINTS_A_BUCKET = 500_000, 1 << 20


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each (lower-cased) text."""
    words = Words(texts, NOT_BLANK)
    h = words.hash
    whole = h.copy() if len(h) < SIZE else np.zeros(len(h), np.uint64)
    if len(h) >= SIZE:
        run = np.zeros(len(h) - SIZE + 1, np.uint64)
        for k in range(SIZE):
            run = run * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(run)]
        whole[: len(run)] = mix(run)
    for i in range(len(texts)):
        lo, hi = int(words.first[i]), int(words.first[i + 1])
        if hi - lo >= SIZE:
            yield np.unique(whole[lo : hi - SIZE + 1])
        elif hi > lo:  # the whole sequence as one
            acc = np.uint64(hi - lo)
            with np.errstate(over="ignore"):
                for x in h[lo:hi]:
                    acc = acc * np.uint64(0x9E3779B97F4A7C15) + x
            yield mix(np.array([acc ^ np.uint64(0xA5A5A5A5)]))
        else:
            yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> int:
    """A 64-bit name of the set: the sum of its mixed hashes, as a signed number."""
    return int((mix(shingles ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64) + np.uint64(len(shingles))).astype(np.int64))


def point(shingles: np.ndarray) -> bytes:
    """Counts by hash group, a byte each; 255 stands for any count from there."""
    return np.minimum(np.bincount((shingles & np.uint64(DIMS - 1)).astype(np.int64), minlength=DIMS), 255).astype(np.uint8).tobytes()


def points_of(packed: list[bytes]) -> np.ndarray:
    out = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, DIMS).astype(np.int16)
    out[out == 255] = np.iinfo(np.int16).max  # no bound on this coordinate
    return out


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b).sum(1, dtype=np.int64)


def _sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    texts = [(x.as_py() or "").encode().lower() for x in batch.column("text")]
    for lo, hi in blocks(texts, 1 << 20):
        yield from shingle_sets(texts[lo:hi])


def text_sha() -> Column:
    return F.sha2(text_of("text"), 256)


def profiles(docs: DataFrame, bucket_bits: int) -> DataFrame:
    """doc_id, sha (of the text), n, sig, point of every row; and rows (bucket, prints): 32 bits of every shingle hash, by its first bits, packed."""
    from pyspark.sql.pandas.types import to_arrow_type

    names = ["doc_id", "sha", "n", "sig", "point", "bucket", "prints"]
    id_type = docs.schema["doc_id"].dataType
    id_arrow = to_arrow_type(id_type)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        known: set[int] = set()

        def flush() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held))  # by bucket, then by print
            prints = (h >> np.uint64(32 - bucket_bits)).astype("<u4")
            cuts = np.searchsorted(h, np.arange(1 << bucket_bits, dtype=np.uint64) << np.uint64(64 - bucket_bits)) if bucket_bits else np.zeros(1, np.int64)
            parts = [(k, prints[x:y].tobytes()) for k, (x, y) in enumerate(zip(cuts, [*cuts[1:], len(h)], strict=True)) if y > x]
            m = len(parts)
            return pa.RecordBatch.from_arrays([pa.nulls(m, id_arrow), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names)

        for batch in slices_of(batches):
            n, sig, points = [], [], []
            for s in _sets(batch):
                n.append(len(s))
                sig.append(signature(s))
                points.append(point(s))
                if len(s) and sig[-1] not in known:
                    known.add(sig[-1])
                    held.append(s)
            m = len(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sha"), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(points, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
            if sum(map(len, held)) > 1_500_000:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return docs.select("doc_id", "text", text_sha().alias("sha")).mapInArrow(run, f"doc_id {id_type.simpleString()}, sha string, n long, sig long, point binary, bucket int, prints binary")


def frequent(made: DataFrame, bucket_bits: int) -> DataFrame:
    """(names, levels, n): the shingles of at least LEVELS[0] occurrences by bucket, as the hash's first bits, and their levels."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        give_back(1.0)
        x = np.concatenate([np.frombuffer(v, "<u4") for v in part["prints"]])
        u, c = np.unique(x, return_counts=True)
        u, c = u[c >= LEVELS[0]], c[c >= LEVELS[0]]
        name = (np.uint64(int(part["bucket"].iloc[0])) << np.uint64(32)) | u.astype(np.uint64)
        return pd.DataFrame({"names": [name.tobytes()], "levels": [np.searchsorted(LEVELS, c, "right").astype(np.uint8).tobytes()], "n": [len(u)]})

    return made.filter("bucket is not null").select("bucket", "prints").groupBy("bucket").applyInPandas(run, "names binary, levels binary, n long")


def _places(names: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(names)
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def level_table(found: DataFrame, bits: int) -> np.ndarray:
    """2**bits levels; a shingle's is the lesser of its two places."""

    def entries(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for names, own in zip(batch.column("names"), batch.column("levels"), strict=True):
            x, y = np.frombuffer(names.as_buffer(), np.uint64), np.frombuffer(own.as_buffer(), np.uint8)
            for at in _places(x, bits):
                yield at, y

    return hashed_table(found.select("names", "levels"), bits, entries)


def leading(shingles: np.ndarray, levels: np.ndarray, bits: int, bucket_bits: int) -> np.ndarray:
    """The first shingles in the global order, rare ones first, without those that occur once."""
    n = len(shingles)
    most = min(n, n - -(-NUM * n // DEN) + SHARED)
    a, b = _places(shingles >> np.uint64(32 - bucket_bits), bits)
    level = np.minimum(levels[a], levels[b]).astype(np.uint64)
    order = np.argsort((level << np.uint64(58)) | (shingles >> np.uint64(6)))[:most]
    return shingles[order[level[order] > 0]]


def dealt(docs: DataFrame, levels, bits: int, bucket_bits: int, buckets: int) -> DataFrame:
    """(bucket, shingles, sigs, sizes): the leading shingles of all rows, packed by bucket; equal sets once a task."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        known: set[int] = set()
        rows = 0

        def flush() -> pa.RecordBatch:
            s, g, n = (np.concatenate(x) for x in zip(*held, strict=True))
            b = (s % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            cuts = np.searchsorted(b[order], np.arange(buckets + 1))
            out = [(k, order[cuts[k] : cuts[k + 1]]) for k in range(buckets) if cuts[k + 1] > cuts[k]]
            arrays = [pa.array([k for k, _ in out], pa.int32())] + [pa.array([x[o].tobytes() for _, o in out], pa.binary()) for x in (s, g, n)]
            return pa.RecordBatch.from_arrays(arrays, ["bucket", "shingles", "sigs", "sizes"])

        for batch in slices_of(batches):
            for s in _sets(batch):
                if not len(s) or (g := signature(s)) in known:
                    continue
                known.add(g)
                lead = leading(s, levels.value, bits, bucket_bits)
                if not len(lead):
                    continue
                held.append((lead, np.full(len(lead), g, np.int64), np.full(len(lead), len(s), np.int32)))
                rows += len(lead)
                if rows > 1_000_000:
                    yield flush()
                    held.clear()
                    rows = 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "bucket int, shingles binary, sigs binary, sizes binary")


def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes whose sets can reach the threshold."""
    return NUM * np.maximum(a, b) <= DEN * np.minimum(a, b)


def needed(a, b):
    """The least overlap of two sets of these sizes that reaches the threshold."""
    return -(-NUM * (a + b) // (NUM + DEN))


def met(packed: DataFrame) -> DataFrame:
    """Per bucket: pairs (a, b, size_a, size_b, n = times met, hub) and members (a, size_a, shingle) of large shards."""
    names = ["a", "b", "size_a", "size_b", "n", "hub", "shingle"]

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        give_back(1.0)
        s = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["shingles"]])
        g = np.concatenate([np.frombuffer(x, np.int64) for x in rows["sigs"]])
        n = np.concatenate([np.frombuffer(x, np.int32) for x in rows["sizes"]]).astype(np.int64)
        order = np.lexsort((g, s))
        s, g, n = s[order], g[order], n[order]
        new = np.append(True, (s[1:] != s[:-1]) | (g[1:] != g[:-1]))
        s, g, n = s[new], g[new], n[new]
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        count = np.diff(np.append(first, len(s)))
        start, many = np.repeat(first, count), np.repeat(count, count)
        out: list[pd.DataFrame] = []
        pairs = []
        for d in range(1, SMALL):  # pairs at distance d within small shards
            i = np.flatnonzero((many[d:] <= SMALL) & (start[d:] == start[:-d]))
            i = i[fits(n[i], n[i + d])]
            pairs.append(np.stack([g[i], g[i + d], n[i], n[i + d]]))
        p = np.concatenate(pairs, axis=1)
        if p.shape[1]:
            rows_ = pd.DataFrame(p.T, columns=["a", "b", "size_a", "size_b"]).groupby(["a", "b", "size_a", "size_b"], as_index=False).size().rename(columns={"size": "n"})
            out.append(rows_.assign(hub=False, shingle=0))
        large = np.flatnonzero(many > SMALL)
        if len(large):
            # the hub of a shard: the set whose mixed signature is least, so that shards of one group of copies agree
            draw = mix(g[large].view(np.uint64))
            heads, at = np.unique(start[large], return_inverse=True)
            best = np.lexsort((draw, at))
            hub = g[large][best[np.searchsorted(at[best], np.arange(len(heads)))]][at]
            hub_n = n[large][best[np.searchsorted(at[best], np.arange(len(heads)))]][at]
            out.append(pd.DataFrame({"a": g[large], "b": 0, "size_a": n[large], "size_b": 0, "n": 0, "hub": False, "shingle": s[large].view(np.int64)}).assign(n=-1))
            # of its shards' hubs, a set takes the least: the second round has no need of this one's pairs
            by = np.lexsort((mix(hub.view(np.uint64)), g[large]))
            k = np.zeros(len(large), bool)
            k[by[np.append(True, g[large][by][1:] != g[large][by][:-1])]] = True
            k &= (hub != g[large]) & fits(hub_n, n[large])
            star = pd.DataFrame({"a": np.minimum(hub, g[large])[k], "b": np.maximum(hub, g[large])[k], "size_a": np.where(hub < g[large], hub_n, n[large])[k], "size_b": np.where(hub < g[large], n[large], hub_n)[k]})
            out.append(star.drop_duplicates().assign(n=1, hub=True, shingle=0))
        return pd.concat(out)[names] if out else pd.DataFrame({x: pd.Series([], dtype="bool" if x == "hub" else "int64") for x in names})

    return packed.groupBy("bucket").applyInPandas(run, "a long, b long, size_a long, size_b long, n long, hub boolean, shingle long")


# --- R-tree ------------------------------------------------------------------------------------


class Tree:
    """Leaves of ``LEAF`` points and nodes of ``LEAF`` leaves, packed in order of size, each with its upper corner and sizes."""

    LEAF = 32

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points.argmax(1), sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        high, low_n, high_n = self.points, self.sizes, self.sizes
        while len(high) > self.LEAF or not self.levels:
            at = np.arange(0, len(high), self.LEAF)
            high, low_n, high_n = np.maximum.reduceat(high, at), np.minimum.reduceat(low_n, at), np.maximum.reduceat(high_n, at)
            self.levels.append((high, low_n, high_n))

    def search(self, q: np.ndarray, n: int) -> np.ndarray:
        """Indexes of points whose bound on the overlap reaches the threshold."""
        at = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            high, low_n, high_n = self.levels[k]
            fine = (DEN * high_n[at] >= NUM * n) & (NUM * low_n[at] <= DEN * n)
            at = at[fine]
            least = np.maximum(low_n[at], -(-NUM * n // DEN))
            at = at[overlap_bound(high[at], q) >= needed(least, n)]
            at = (at[:, None] * self.LEAF + np.arange(self.LEAF)).ravel()
            at = at[at < (len(self.levels[k - 1][0]) if k else len(self.points))]
        at = at[fits(self.sizes[at], np.int64(n))]
        at = at[overlap_bound(self.points[at], q) >= needed(self.sizes[at], n)]
        return self.order[at]


def searched(members: DataFrame, nearest: int | None) -> DataFrame:
    """(a, b) of different components that the tree of their shard does not rule out. members: shard, x, y, block, sig, n, point, label.

    nearest: of a set's pairs in a shard, only so many of the highest bounds.
    """

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        give_back(1.0)
        points = points_of(rows["point"].tolist())
        n, g, label, block = (rows[c].to_numpy() for c in ("n", "sig", "label", "block"))
        x, y = int(rows["x"].iloc[0]), int(rows["y"].iloc[0])
        inner = np.flatnonzero(block == y)
        tree = Tree(points[inner], n[inner])
        found = [np.zeros((2, 0), np.int64)]
        for i in np.flatnonzero(block == x):
            j = inner[tree.search(points[i], int(n[i]))]
            j = j[label[j] != label[i]]
            if nearest is None:
                j = j[(g[j] > g[i]) | (x != y)]
            elif len(j) > nearest:
                bound = overlap_bound(points[j], points[i])
                j = j[np.argsort(bound / (n[j] + n[i] - bound + 1e-9))[-nearest:]]
            found.append(np.stack([np.minimum(g[i], g[j]), np.maximum(g[i], g[j])]))
        a, b = np.concatenate(found, axis=1)
        return pd.DataFrame({"a": a, "b": b})

    return members.groupBy("shard", "x", "y").applyInPandas(run, "a long, b long")


# --- verification ------------------------------------------------------------------------------


def bloom_of(sigs: DataFrame) -> np.ndarray:
    """A Bloom filter (two probes, fixed size) of a column of signatures. It only saves work: what it passes is joined exactly."""

    def entries(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = np.unique(np.concatenate(_probes(batch.column(0).to_numpy(zero_copy_only=False))))
        yield at, np.ones(len(at), np.uint8)

    return hashed_table(sigs, BLOOM_BITS, entries, packed=True)


def _probes(sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(sigs.view(np.uint64))
    return (h >> np.uint64(64 - BLOOM_BITS)).astype(np.int64), (h & np.uint64((1 << BLOOM_BITS) - 1)).astype(np.int64)


def sets_of(docs: DataFrame, bloom) -> DataFrame:
    """(sig, shingles): the whole sets of the rows whose signature passes the filter, once each."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bloom.value
        known: set[int] = set()
        for batch in slices_of(batches):
            sig, out = [], []
            for s in _sets(batch):
                if len(s) and (g := signature(s)) not in known and all(bits[at[0] >> 3] >> (7 - (at[0] & 7)) & 1 for at in _probes(np.array([g]))):
                    known.add(g)
                    sig.append(g)
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(out, pa.binary())], ["sig", "shingles"])

    return docs.select("text").mapInArrow(run, "sig long, shingles binary").dropDuplicates(["sig"])


def bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose sum of coordinate minima reaches the threshold."""
    one = nodes.select(F.col("sig").alias("a"), F.col("point").alias("pa"), F.col("n").alias("na"))
    two = nodes.select(F.col("sig").alias("b"), F.col("point").alias("pb"), F.col("n").alias("nb"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pa_, pb = (points_of(batch.column(c).to_pylist()) for c in ("pa", "pb"))
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            fine = fits(na, nb) & (overlap_bound(pa_, pb) >= needed(na, nb))
            yield batch.select(["a", "b"]).filter(pa.array(fine))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "pa", "pb", "na", "nb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose whole sets reach the threshold."""
    one, two = sets.select(F.col("sig").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("sig").alias("b"), F.col("shingles").alias("sb"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches):
            fine = []
            for a, b in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                fine.append(DEN * inter >= NUM * (len(both) - inter))
            yield batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def linked(xs: list[np.ndarray], ys: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """With how many sets of ys each of xs is linked, and the other way round; ys None: within xs.

    Overlaps are a product of incidence matrices. Shingles that most sets have are multiplied as dense columns, the others are counted
    by their pairs of sets, whichever costs less; a shingle of one set counts for nothing.
    """
    same, others = ys is None, xs if ys is None else ys
    nx, ny = len(xs), len(others)
    size_x, size_y = (np.fromiter(map(len, sets), np.int64, len(sets)) for sets in (xs, others))
    flat_x, flat_y = np.concatenate([np.zeros(0, np.uint64), *xs]), np.concatenate([np.zeros(0, np.uint64), *others])
    if same:
        own, many = np.unique(flat_x, return_counts=True)
        shared = own[many > 1]
    else:
        shared = np.intersect1d(flat_x, flat_y)
    both = np.zeros((nx, ny), np.float32)
    if len(shared):
        sides = []
        for flat, size in ((flat_x, size_x), (flat_y, size_y)):
            at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
            live = shared[at] == flat
            column, row = at[live], np.repeat(np.arange(len(size)), size)[live]
            order = np.argsort(column, kind="stable")
            sides.append((column[order], row[order], np.bincount(column, minlength=len(shared))))
        (cx, rx, mx), (cy, ry, my) = sides
        dense = mx * my * PAIR_COST > nx * ny
        number = np.cumsum(dense) - 1
        for lo in range(0, int(dense.sum()), COLUMNS):
            parts = []
            for column, row, n in ((cx, rx, nx), (cy, ry, ny)):
                live = dense[column] & (number[column] >= lo) & (number[column] < lo + COLUMNS)
                part = np.zeros((n, min(COLUMNS, int(dense.sum()) - lo)), np.float32)
                part[row[live], number[column[live]] - lo] = 1
                parts.append(part)
            both += parts[0] @ parts[1].T
        begin = np.cumsum(my) - my
        light = np.flatnonzero(~dense[cx])
        upto = np.cumsum(my[cx[light]])
        lo = 0
        while lo < len(light):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + (1 << 21))))
            own = light[lo:hi]
            many = my[cx[own]]
            at = np.repeat(begin[cx[own]] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            np.add.at(both.ravel(), np.repeat(rx[own], many) * ny + ry[at], 1)
            lo = hi
    near = (both > 0) & ((NUM + DEN) * both >= NUM * (size_x[:, None] + size_y[None, :]).astype(np.float32))
    if same:
        np.fill_diagonal(near, False)
    return near.sum(1), near.sum(0)


def degrees(labels: DataFrame, sets: DataFrame) -> DataFrame:
    """(sig, n_links): with how many other sets each labelled set is linked, counted over all pairs of its component, in blocks."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        give_back(1.0)
        out = []
        for _, own in rows.groupby("label", sort=False):
            sig, block = own["sig"].to_numpy(), own["block"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in own["shingles"]]
            x, y = int(own["x"].iloc[0]), int(own["y"].iloc[0])
            a, b = np.flatnonzero(block == x), np.flatnonzero(block == y)
            if x == y:
                out.append((sig[a], linked([sets[i] for i in a], None)[0]))
            else:
                n, m = linked([sets[i] for i in a], [sets[i] for i in b])
                out += [(sig[a], n), (sig[b], m)]
        sigs, ns = zip(*out, strict=True)
        return pd.DataFrame({"sig": np.concatenate(sigs), "n": np.concatenate(ns).astype(np.int64)})

    own = labels.withColumnRenamed("node", "sig").join(sets, "sig")
    parts = F.greatest(F.ceil(F.sum(F.octet_length("shingles")) / BLOCK_BYTES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int")
    total = own.groupBy("label").agg(parts.alias("parts"), F.sum(F.octet_length("shingles")).alias("bytes"), F.count("*").alias("size"))
    total = written(labels.sparkSession, total, "sizes")
    bins = max(1, -(-int(total.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]) // BLOCK_BYTES))
    own = hot_lookup(own, "label", total, ["parts"], "sig")
    own = own.withColumns({"block": F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
    # small components share a task
    own = own.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other"), "large": F.col("parts") > 1, "part": F.when(F.col("parts") > 1, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(bins)))})
    return own.select("large", "part", "x", "y", "block", "label", "sig", "shingles").groupBy("large", "part", "x", "y").applyInPandas(run, "sig long, n long").groupBy("sig").agg(F.sum("n").alias("n_links"))


def jaccard_classes(docs: DataFrame, count: bool = True, told: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other sets linked with the row's own; null unless ``count``) of every row of docs.

    told: also sha (of the text), kept (whether the row is its component's first by doc_id, then sha).
    """
    out = _classes(docs, count)
    return out if told else out.drop("sha", "kept")


def _classes(docs: DataFrame, count: bool) -> DataFrame:
    spark = docs.sparkSession
    sc = spark.sparkContext
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bucket_bits = min(30, max(0, (size // 6 // PRINTS_A_BUCKET).bit_length()))
    made = written(spark, profiles(docs, bucket_bits), "profiles")
    rows = made.filter("bucket is null").select("doc_id", "sha", "n", "sig", "point")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")).alias("first")
    nodes = written(spark, rows.filter("n > 0").groupBy("sig").agg(F.first("n").alias("n"), F.first("point").alias("point"), first, F.count("*").alias("size")), "nodes")
    found = written(spark, frequent(made, bucket_bits), "frequent")
    many = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, (4 * many).bit_length()))
    levels = sc.broadcast(level_table(found, bits) if many else np.zeros(1 << bits, np.uint8))  # at most 2**MOST_BITS bytes
    packed = dealt(docs, levels, bits, bucket_bits, max(1, -(-2 * many // ROWS_A_BUCKET)))
    pairs = written(spark, met(packed), "met")

    members = pairs.filter("n = -1").select(F.col("a").alias("sig"), F.col("size_a").alias("n"), F.col("shingle").alias("shard"))
    often = pairs.filter("n > 0").groupBy("a", "b").agg(F.sum(F.when(~F.col("hub"), F.col("n"))).alias("n"), F.max("hub").alias("hub"), F.first("size_a").alias("na"), F.first("size_b").alias("nb"))
    least = F.least(F.lit(SHARED), F.ceil((F.col("na") + F.col("nb")) * NUM / (NUM + DEN)))
    close = written(spark, bounded(often.filter(F.col("hub") | (F.col("n") >= least)).select("a", "b"), nodes), "close")

    wanted = close.select(F.col("a").alias("sig")).union(close.select("b")).union(members.select("sig").distinct())
    bloom = bloom_of(wanted)
    if not bloom.any():
        return _told(rows, nodes, None)
    sets = written(spark, sets_of(docs, sc.broadcast(bloom)), "sets")
    links = written(spark, verified(close, sets), "links")
    labels = components(links)

    tried = close
    for nearest in (NEAREST, None):
        named = members.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
        open_ = written(spark, named.groupBy("shard").agg(F.count("*").alias("m"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("shard", "m", F.col("m").alias("size")), "open")
        left = hot_lookup(named, "shard", open_, ["m"], "sig").filter("m is not null").join(nodes.select("sig", "point"), "sig")
        parts = F.ceil(F.col("m") / SHARD).cast("int")
        left = left.withColumns({"block": F.pmod(F.xxhash64("sig"), parts).cast("int"), "other": F.explode(F.sequence(F.lit(0), parts - 1))})
        left = left.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).select("shard", "x", "y", "block", "sig", "n", "point", "label")
        new = written(spark, searched(left, nearest).distinct().join(tried, ["a", "b"], "left_anti"), "searched")
        if new.isEmpty():
            continue
        tried = tried.union(new)
        more = written(spark, verified(new, sets), "links")
        if not more.isEmpty():
            links = links.union(more)
            labels = components(links)
    return _told(rows, nodes, (degrees(labels, sets) if count else links.select(F.col("a").alias("sig"), F.lit(None).cast("long").alias("n_links")).limit(0), labels))


def _told(rows: DataFrame, nodes: DataFrame, found: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """Adds to each row its class: component_id, n_links, and kept (the sha of the component's first row; whether the row is such a one)."""
    spark = rows.sparkSession
    if found is None:
        classes = nodes.select("sig", "size", "first", F.lit(0).cast("long").alias("n_links"))
    else:
        degree, labels = found
        own = nodes.select("sig", "first", "size").join(labels.withColumnRenamed("node", "sig"), "sig").join(degree, "sig", "left")
        best = own.groupBy("label").agg(F.min("first").alias("best"))
        linked = own.join(best, "label").select("sig", "best", "n_links")
        classes = nodes.select("sig", "size", "first").join(linked, "sig", "left")
        classes = classes.select("sig", "size", F.coalesce("best", "first").alias("first"), F.when(F.col("best").isNull(), 0).otherwise(F.col("n_links")).alias("n_links"))
    classes = written(spark, classes.select("sig", "size", "n_links", F.col("first.doc_id").alias("component_id"), F.col("first.sha").alias("first_sha")), "classes")
    out = hot_lookup(rows.filter("n > 0").drop("point"), "sig", classes, ["component_id", "n_links", "first_sha"], "doc_id")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("sha") == F.col("first_sha"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links", "sha", kept.alias("kept"))
    return out.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), "sha", F.lit(True).alias("kept")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, exactly one of each component: its smallest doc_id (nulls last), of equal ones the least SHA-256 of the text.

    A row is known by doc_id and text, so ids may be null or repeat. Of rows that agree in both, one stays. Rows without words are linked with nothing
    and all stay.
    """
    told = jaccard_classes(docs, count=False, told=True)
    gone = told.filter(~F.col("kept")).select(_row_key(F.col("sha")).alias("__row")).distinct()
    wordless = ~text_of("text").rlike(r"[^\x20\x09-\x0D]")
    rows = docs.withColumn("__row", F.when(wordless, F.concat(F.lit("="), F.monotonically_increasing_id().cast("string"))).otherwise(_row_key(text_sha())))
    rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("__row").orderBy("__row"))).filter("__rank = 1")
    return rows.join(gone, "__row", "left_anti").select(docs.columns)


def _row_key(sha: Column) -> Column:
    """A name of (doc_id, text): a null id has no colon."""
    return F.concat_ws(":", sha, F.col("doc_id").cast("string"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
