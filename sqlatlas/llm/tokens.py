"""Tokenizing by pieces between single blanks, with caches; token counts by map-side two-tier lookup.

The byte-level tokenizer cuts a text into pre-tokens by a pattern that never joins a blank to what stands before
it and takes a single blank between two non-blanks as the start of the next pre-token. So cutting at such
blanks leaves every pre-token whole, and the number of tokens of a text is the sum over the pieces. A piece's number is
looked up in a broadcast table of frequent pieces, then in the worker's cache; only misses run the tokenizer. No
pre-token is ever shuffled. Special strings inside a text count as the library has it by default, as one
special token; they part the text first.

Null text counts as empty (0 tokens). Ties, repeated rows and extra columns have no influence: every row is counted by itself.
An empty table gives no rows. A very long piece without blanks is encoded by the library as a whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Entries of the broadcast table, and of a worker's cache with it: bounds of their memory.
FREQUENT, CACHED = 50_000, 500_000
#: Rows of the sample that fills the broadcast table. It decides speed only, no result.
PRIME_ROWS = 2_000

_NEAR_BLANK = re.compile(r" \s|\s ")
_SINGLE = re.compile(r"(?<!\s) (?!\s)")


def pieces(text: str) -> list[str]:
    """text cut at the single blanks between non-blanks; each piece but the first had one before it."""
    return text.split(" ") if not _NEAR_BLANK.search(text) else _SINGLE.split(text)


#: One run of precomposed Latin letters, then marks that always begin a pre-token of their own (no apostrophe).
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes bytes as letters: printable ones as themselves, the others from 256 upward, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


def byte_level(text: str) -> str:
    return text.encode().decode("latin-1").translate(BYTE_LETTERS)


class Lengths(dict):
    """Number of tokens of ' ' + piece; a miss is encoded and kept while there is room.

    A piece of letters and marks is a pre-token ' letters' and one of marks, so the model alone gives its length.
    """

    def __init__(self, tokenizer, frequent: dict[str, int] = {}):  # noqa: B006
        super().__init__(frequent)
        self.tokenizer, self.model, self.marks = tokenizer, tokenizer.model, {"": 0}

    def _marks(self, marks: str) -> int:
        n = self.marks.get(marks)
        if n is None:
            n = len(self.tokenizer.encode(marks, add_special_tokens=False).ids)
            if len(self.marks) < 1000:
                self.marks[marks] = n
        return n

    def __missing__(self, piece: str) -> int:
        if m := PLAIN.fullmatch(piece):
            n = len(self.model.tokenize(byte_level(" " + m[1]))) + self._marks(m[2])
        else:
            n = len(self.tokenizer.encode(" " + piece, add_special_tokens=False).ids)
        if len(self) < CACHED and len(piece) < 200:
            self[piece] = n
        return n


def load_tokenizer(spec: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


#: A worker process keeps a tokenizer and its cache for its next tasks.
_KEPT: dict[tuple[str, str], tuple] = {}


def kept(spec: str, cache: type) -> tuple:
    """(tokenizer, cache) of this worker."""
    key = (cache.__name__, hashlib.sha256(spec.encode()).hexdigest())
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = (t := load_tokenizer(spec), cache(t))
    return _KEPT[key]


class Specials:
    """The special strings of a tokenizer, and what all of them begin with (a quick test)."""

    def __init__(self, tokenizer):
        names = sorted((x.content for x in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.begin = os.path.commonprefix(names)
        self.pattern = re.compile("|".join(map(re.escape, names))) if names else None

    def within(self, text: str) -> bool:
        return self.pattern is not None and self.begin in text and bool(self.pattern.search(text))

    def parts(self, text: str) -> list[str]:
        return self.pattern.split(text) if self.within(text) else [text]


def cuts_at_blanks(spec: str) -> bool:
    """Whether a tokenizer file is byte-level with the usual pattern, so that cutting at single blanks is exact."""
    told = json.loads(spec)
    step = told.get("pre_tokenizer") or {}
    plain = not told.get("normalizer") and not told.get("post_processor") and not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in told.get("added_tokens", ()))
    return plain and (step.get("type"), step.get("add_prefix_space"), step.get("use_regex")) == ("ByteLevel", False, True)


def frequent_pieces(docs: DataFrame, rows: int) -> Counter:
    """Pieces of the whole texts of about ``rows`` rows, drawn by a hash of the id over all of docs, with their numbers.

    The ids come from a scan of that column alone; the texts are read by id, which skips what the file's statistics rule out.
    """
    every = max(1, docs.count() // rows)
    drawn = docs.select("doc_id").filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).limit(4 * rows)
    ids = sorted({r.doc_id for r in drawn.collect() if r.doc_id is not None})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                seen.update(x for x in pieces(text.as_py() or "")[1:] if len(x) < 64)
        most = seen.most_common(FREQUENT)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in most], pa.string()), pa.array([n for _, n in most], pa.int64())], ["piece", "n"])

    total: Counter = Counter()
    if ids:
        for piece, n in docs.filter(F.col("doc_id").isin(ids)).select("text").mapInArrow(run, "piece string, n long").toLocalIterator():
            total[piece] += n
    return total


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row of docs."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    tokenizer = load_tokenizer(spec)
    special, exact = Specials(tokenizer), cuts_at_blanks(spec)
    seen = frequent_pieces(docs, PRIME_ROWS) if exact else Counter()
    common = [x for x, _ in sorted(seen.items(), key=lambda p: (-p[1], p[0]))[:FREQUENT] if not special.within(x)]
    encoded = tokenizer.encode_batch([" " + x for x in common], add_special_tokens=False)
    tiers = spark.sparkContext.broadcast((spec, exact, "".join(common), np.array([len(x) for x in common], np.uint8).tobytes(), np.array([len(e.ids) for e in encoded], np.uint8).tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, exact, common, chars, sizes = tiers.value
        tokenizer, lengths = kept(spec, Lengths)
        special = Specials(tokenizer)
        if len(lengths) < len(sizes):  # a worker takes the table once
            ends = list(accumulate(chars))
            lengths.update(zip((common[e - n : e] for e, n in zip(ends, chars, strict=True)), sizes, strict=True))
        find, whole = lengths.__getitem__, lambda x: len(tokenizer.encode(x, add_special_tokens=False).ids)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                n = 0
                parts = special.parts(text) if exact else [text]
                for part in parts:
                    cut = pieces(part) if exact else [part]
                    n += (whole(cut[0]) if cut[0] else 0) + sum(map(find, cut[1:]))
                n_bytes.append(len(text.encode()))
                n_tokens.append(n + len(parts) - 1)
            over = [n > limit for n in n_tokens]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(over)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
