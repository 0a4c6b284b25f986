"""Best-fit packing by bin completion, branch and bound, over documents cut into pieces.

Tokenizing is a map over the rows, with a worker cache of the ids between white space; only piece lengths and checksums
leave it. Whole sequences stand alone. The other pieces are dealt by hash into groups of about
``GROUP_TOKENS`` tokens and at most about ``GROUP_ROWS`` rows, so groups do not grow with the input, and a group
wastes less than one sequence beyond what its bound demands. In a group:

* bin completion builds the bins: around the largest piece left, undominated fillings of the rest of the bin are listed, least waste
  first (a filling is dominated if a piece left fits into its slack, or could replace a smaller one of it), and the search goes
  down the first, back to the next, and so on; a branch whose waste passes what the incumbent allows is cut;
* best-fit decreasing is the first incumbent; it stays only if no packing by completion has as few bins;
* the search ends at the bound ceil(sum / capacity), or when it is exhausted, or after ``NODES_A_BIN`` nodes for each bin of the
  incumbent (``NODES`` at least). A bin lists at most ``FILLINGS`` fillings, from ``TRIES`` sizes a level. ``nodes`` and ``proven`` tell how it ended.

Null or empty text is the single id 1. Repeated rows are pieces of their own. Ties among equal lengths go by
doc_id and piece. A null doc_id is packed like any other. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, slices_of, table, tidy, written
from .tokens import CACHED, Specials, byte_level, kept

CAPACITY, END_ID = 4096, 1
GROUP_TOKENS, GROUP_ROWS = 16 << 20, 200_000
NODES, NODES_A_BIN, FILLINGS, TRIES = 3_000, 3, 12, 4


#: The tokenizer's own pattern for texts of ASCII and precomposed Latin letters only, lower-cased.
_PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_FOREIGN = re.compile(r"[^\t-\r -~À-ÖØ-öø-ÿ]")


#: The normalizer and the splitter that the two patterns stand for. Any other tokenizer encodes whole texts by the library.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_alike(spec: str) -> bool:
    """Whether a tokenizer file normalizes and splits as ``_PRE_TOKEN`` does."""
    told = json.loads(spec)
    steps = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}
    byte_level = len(steps) == 2 and (steps[1].get("type"), steps[1].get("add_prefix_space"), steps[1].get("use_regex")) == ("ByteLevel", False, False)
    return (told.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and steps[0] == split and byte_level and not told.get("post_processor")


class Ids(dict):
    """Little-endian 32-bit ids of a pre-token; a miss is encoded by the model and kept while there is room."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model, self.alike = tokenizer, tokenizer.model, splits_alike(tokenizer.to_str())

    def __missing__(self, pre: str) -> bytes:
        ids = packed_ids([x.id for x in self.model.tokenize(byte_level(pre))])
        if len(self) < CACHED and len(pre) < 200:
            self[pre] = ids
        return ids

    def of(self, text: str) -> bytes:
        """Ids of a whole text without special strings. Texts with other characters go to the library."""
        if not self.alike or _FOREIGN.search(text):
            return packed_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.__getitem__, _PRE_TOKEN.findall(text.lower())))


def packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def tokenized(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row.

    The tokenizer's normalizer composes characters, lower-cases them and turns white space into blanks, which its pattern then
    drops; of texts that need no composing, the same pattern gives the pre-tokens here, and the model their ids.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, ids = kept(spec.value, Ids)
        special = Specials(tokenizer)
        end = packed_ids([END_ID])
        for batch in slices_of(batches):
            rows = [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                text = text.as_py() or ""
                if special.within(text):
                    data = packed_ids(tokenizer.encode(text, add_special_tokens=False).ids) + end
                else:
                    data = ids.of(text) + end
                n = len(data) // 4
                for k in range(0, n, capacity):
                    cut = data[4 * k : 4 * (k + capacity)]
                    for col, x in zip(rows, (doc_id.as_py(), k // capacity, k, len(cut) // 4, zlib.crc32(cut)), strict=True):
                        col.append(x)
            kinds = batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins of indexes. Free space is kept as a bit set, so the tightest bin is one shift away."""
    bins: list[list[int]] = []
    free: dict[int, list[int]] = {}
    mask = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = mask >> sizes[i]
        if fits:
            room = sizes[i] + (fits & -fits).bit_length() - 1
            k = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
            bins[k].append(i)
        else:
            k, room = len(bins), capacity
            bins.append([i])
        if left := room - sizes[i]:
            free.setdefault(left, []).append(k)
            mask |= 1 << left
    return bins


class Pieces:
    """Numbers of pieces by size; the sizes that are left are also a bit set, so the largest one below a bound is one mask away."""

    def __init__(self, sizes: list[int], capacity: int):
        self.count, self.mask = [0] * (capacity + 1), 0
        for x in sizes:
            self.put(x)

    def put(self, x: int) -> None:
        self.count[x] += 1
        self.mask |= 1 << x

    def take(self, x: int) -> None:
        self.count[x] -= 1
        if not self.count[x]:
            self.mask ^= 1 << x

    def largest(self, most: int) -> int:
        """0 if there is none."""
        return max(0, (self.mask & ((2 << most) - 1)).bit_length() - 1) if most > 0 else 0


def fillings(left: Pieces, room: int, most: int) -> tuple[list[tuple[int, ...]], bool]:
    """Undominated multisets of the sizes left for ``room``, least waste first, at most ``most``; and whether these are all of them."""
    found: dict[tuple[int, ...], int] = {}
    budget, whole = 40 * most, True

    def undominated(chosen: list[int], slack: int) -> bool:
        """No piece left fits into the slack, or could stand in a smaller one's place."""
        return not slack or (not left.largest(slack) and all(left.largest(x + slack) <= x for x in set(chosen)))

    def grow(limit: int, slack: int, chosen: list[int]) -> None:
        nonlocal budget, whole
        x = left.largest(min(limit, slack))
        if not x:
            if undominated(chosen, slack):
                found[tuple(chosen)] = slack
            return
        tried = 0
        while x:
            if not budget or tried == TRIES or len(found) == most:
                whole = False
                return
            budget -= 1
            tried += 1
            left.take(x)
            chosen.append(x)
            grow(x, slack - x, chosen)
            chosen.pop()
            left.put(x)
            x = left.largest(x - 1)

    grow(room, room, [])
    return sorted(found, key=lambda c: (found[c], len(c))), whole


class Packing(NamedTuple):
    bins: list[list[int]]  # indexes of the sizes
    nodes: int  # bins placed by the search
    proven: bool  # no packing has fewer bins: the bound is met, or the search was exhausted


def complete(sizes: list[int], capacity: int, nodes: int | None = None) -> Packing:
    """Bin completion by depth-first branch and bound.

    A node is the largest piece left with an undominated filling of its bin. Best-fit decreasing is the incumbent that the waste
    is held against; a packing by completion takes its place as soon as it has no more bins.
    """
    incumbent = best_fit(sizes, capacity)
    total = sum(sizes)
    bound = -(-total // capacity)
    if not sizes:
        return Packing([], 0, True)
    if nodes is None:
        nodes = max(NODES, NODES_A_BIN * len(incumbent))
    left, placed, number = Pieces(sizes, capacity), 0, len(sizes)
    stack: list[tuple[tuple[int, ...], list, int]] = []  # bin taken, other choices, waste before it
    waste, used = 0, 0
    best: list[tuple[int, ...]] | None = None
    allowed = len(incumbent) * capacity - total
    whole = True  # nothing was left out of the search so far

    def choices() -> list[tuple[int, ...]]:
        nonlocal whole
        big = left.largest(capacity)
        left.take(big)
        found, all_of_them = fillings(left, capacity - big, FILLINGS)
        left.put(big)
        whole &= all_of_them
        return [(big, *c) for c in found][::-1] or [(big,)]

    pending = choices()
    exhausted = False
    while used < nodes:
        used += 1
        while pending and waste + capacity - sum(pending[-1]) > allowed and placed + len(pending[-1]) < number:
            pending.pop()
        if pending:
            taken = pending.pop()
            stack.append((taken, pending, waste))
            waste += capacity - sum(taken)
            placed += len(taken)
            for x in taken:
                left.take(x)
            if placed < number:
                pending = choices()
                continue
            if len(stack) <= (len(incumbent) if best is None else len(best) - 1):
                best = [t for t, _, _ in stack]
                if len(best) <= bound:
                    break
                allowed = (len(best) - 1) * capacity - total
            pending = []
        if not stack:
            exhausted = True
            break
        taken, pending, waste = stack.pop()
        placed -= len(taken)
        for x in taken:
            left.put(x)
    at: dict[int, list[int]] = {}
    for i, x in enumerate(sizes):
        at.setdefault(x, []).append(i)
    bins = incumbent if best is None else [[at[x].pop() for x in taken] for taken in best]
    return Packing(bins, used, len(bins) <= bound or (exhausted and whole))


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (a stored table of pieces) with sequence_id and offset; and of the piece's group: nodes (of the search) and proven (no packing of the group has fewer sequences)."""
    whole = cut.filter(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "nodes": F.lit(0).cast("long"), "proven": F.lit(True)})
    rest = cut.filter(F.col("length") < capacity)
    tokens, rows = rest.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-tokens // GROUP_TOKENS), -(-rows // GROUP_ROWS))
    rest = rest.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("long"))

    def pack(part: pa.Table) -> pa.Table:
        give_back(1.0)
        part = part.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        sizes = part["length"].to_pylist()
        found = complete(sizes, capacity)
        for k, items in enumerate(found.bins):
            at = 0
            for i in items:
                sequence[i], offset[i] = k, at
                at += sizes[i]
        group = part["grp"][0].as_py() << 32
        added = {"sequence_id": group + sequence, "offset": offset, "nodes": np.full(len(part), found.nodes), "proven": np.full(len(part), found.proven)}
        for name, values in added.items():
            part = part.append_column(name, pa.array(values))
        return part

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    done = rest.groupBy("grp").applyInArrow(pack, f"{kinds}, grp long, sequence_id long, offset long, nodes long, proven boolean").drop("grp")
    return whole.unionByName(done)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every row in its place."""
    return packed(written(docs.sparkSession, tokenized(docs, tokenizer_path, capacity), "pieces"), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
