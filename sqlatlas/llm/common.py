"""What the training-data operators share: tables, the shared folder, hashing of words.

Nothing outside ``sqlatlas.llm`` imports this subpackage.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark only (the folder may be in a remote store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local session may lack the setting; it then gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    kept = sc._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sqlatlas-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_given_back = 0.0


def give_back(apart: float = 0.0) -> None:
    """Free memory of this process goes back to the system, unless it did so less than ``apart`` seconds ago.

    Allocators keep what was freed, and worker processes outlive their tasks: without this, every worker of an executor
    holds the most that any of its tasks needed.
    """
    global _given_back
    if time.monotonic() - _given_back >= apart:
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
            trim(0)
        _given_back = time.monotonic()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function over the batches of a task, with ``give_back`` at its end."""

    @functools.wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return own


def hot_lookup(rows: DataFrame, key: str, classes: DataFrame, values: list[str], spread_by: str) -> DataFrame:
    """rows left-joined with a stored table of classes (key, size, values); size is the class's number of rows.

    Classes of over a thousandth of all rows (and of 1000 rows at least) number at most 1000: they are
    broadcast. Rows of the others join by key, so no task meets more than such a share of the rows.
    """
    total = classes.agg(F.sum("size")).first()[0] or 0
    bound = max(1000, total // 1000)
    hot = classes.filter(F.col("size") > bound).select(key, *(F.col(v).alias(f"__{v}") for v in values), F.lit(True).alias("__hot"))
    rest = classes.filter(F.col("size") <= bound).select(F.col(key).cast("string").alias("__at"), *values)
    rows = rows.join(F.broadcast(hot), key, "left")
    spread = F.concat_ws("#", key, F.pmod(F.xxhash64(spread_by), F.lit(4096)))
    rows = rows.withColumn("__at", F.when(F.col("__hot"), spread).otherwise(F.col(key).cast("string")))
    rows = rows.join(rest, "__at", "left")
    found = {v: F.when(F.col("__hot"), F.col(f"__{v}")).otherwise(F.col(v)) for v in values}
    return rows.withColumns(found).drop("__at", "__hot", *(f"__{v}" for v in values))


def hashed_table(rows: DataFrame, bits: int, entries: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], packed: bool = False) -> np.ndarray:
    """A table of 2**bits bytes, the largest value given to each place; packed: of bits. entries: (places, values) of a batch of rows.

    Entries are dealt by piece of the table and a task makes a piece, so no task holds the whole; the driver puts the pieces together.
    """
    chunk = min(19, bits)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, value in entries(batch):
                order = np.argsort(at, kind="stable")
                at, value = at[order], value[order]
                home = at >> chunk
                edge = np.flatnonzero(np.append(True, home[1:] != home[:-1])) if len(at) else at
                parts = list(zip(edge, [*edge[1:], len(at)], strict=True)) if len(at) else []
                inner = (at & ((1 << chunk) - 1)).astype("<u4")
                columns = [int(home[a]) for a, _ in parts], [inner[a:b].tobytes() for a, b in parts], [value[a:b].tobytes() for a, b in parts]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["chunk", "places", "values"])

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        give_back(1.0)
        own = np.zeros(1 << chunk, np.uint8)
        for x, y in zip(part["places"], part["values"], strict=True):
            np.maximum.at(own, np.frombuffer(x, "<u4"), np.frombuffer(y, np.uint8))
        return pd.DataFrame({"chunk": [part["chunk"].iloc[0]], "bytes": [(np.packbits(own > 0) if packed else own).tobytes()]})

    pieces = rows.mapInArrow(run, "chunk int, places binary, values binary").groupBy("chunk").applyInPandas(merge, "chunk int, bytes binary")
    out = np.zeros((1 << bits) // 8 if packed else 1 << bits, np.uint8)
    for r in pieces.toLocalIterator():
        own = np.frombuffer(r["bytes"], np.uint8)
        out[r["chunk"] * len(own) : (r["chunk"] + 1) * len(own)] = own
    return out


def text_of(col: str | Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def remainder(col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % n


# --- words of many texts at once -------------------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of x."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, base: np.uint64) -> np.ndarray:
    p = np.empty(n, np.uint64)
    if n:
        p[0] = 1
        p[1:] = base
        np.multiply.accumulate(p, out=p)
    return p


class Words:
    """Start, end and 64-bit hash of every word in the concatenation of some texts.

    ``is_word`` is a table of 256 booleans by byte. A word is a maximal run of such bytes; texts are
    parted by a byte that is none. A hash is a random polynomial over the word's bytes modulo
    2**64, taken in blocks by prefix sums, finished by ``mix``.
    """

    def __init__(self, texts: list[bytes], is_word: np.ndarray):
        sep = bytes([int(np.flatnonzero(~is_word)[0])])
        joined = np.frombuffer(sep.join(texts) + sep, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.ends_at = np.cumsum(sizes)
        inside = is_word[joined]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.bytes = joined
        self.hash = self._hashes(joined)
        #: word range of text i is first[i]:first[i + 1]
        self.first = np.concatenate(([0], np.searchsorted(self.start, self.ends_at)))

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        n, size = len(self.start), self.end - self.start
        out = np.zeros(n, np.uint64)
        longest = int(size.max()) if n else 0
        if longest <= 64:
            live = np.arange(n)
            for k in range(longest):  # byte by byte over all words at once
                if k:
                    live = live[size[live] > k]
                out[live] = (out[live] + _CODE[data[self.start[live] + k]]) * _P
        else:  # prefix sums: H(e) - H(s), times the inverse power
            power = _powers(len(data) + 1, _P)
            run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODE[data] * power[:-1], dtype=np.uint64)))
            inverse = _powers(len(data) + 1, np.uint64(pow(int(_P), -1, 1 << 64)))
            # sum over j of code[j] * P**(j - s), brought to the form of the loop above
            forward = (run[self.end] - run[self.start]) * inverse[self.start]
            out = forward
            short = size <= 64
            out = np.where(short, self._short(data, short), mix(forward ^ np.uint64(0x5851F42D4C957F2D)))
        return mix(out ^ (size.astype(np.uint64) << np.uint64(48)))

    def _short(self, data: np.ndarray, which: np.ndarray) -> np.ndarray:
        size = np.where(which, self.end - self.start, 0)
        out = np.zeros(len(size), np.uint64)
        live = np.flatnonzero(which)
        k = 0
        while len(live):
            out[live] = (out[live] + _CODE[data[self.start[live] + k]]) * _P
            k += 1
            live = live[size[live] > k]
        return out


_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

#: `[^\x20\x09-\x0D]+`
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def slices_of(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in smaller pieces, so that what is made of a piece stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def blocks(rows: list[bytes], most: int = 8 << 20):
    """Ranges of rows of at most ``most`` bytes together, or one row."""
    at, size = 0, 0
    for i, x in enumerate(rows):
        if size and size + len(x) > most:
            yield at, i
            at, size = i, 0
        size += len(x)
    if at < len(rows):
        yield at, len(rows)
