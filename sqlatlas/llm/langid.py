"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

A word's score in a language is the mean log-probability of its byte 2-, 3- and 4-grams and of the word itself, hashed
into ``SLOTS`` slots per kind, learned from labelled rows. A word's script (from the lead bytes of its letters) leaves
as candidates the languages of whose words over 0.1 % have that script, or all if there is none. Viterbi with a switching penalty then
labels the words of a text, for all texts of a batch at once. The predicted language is that of
most letters; the score is its share of the letters.

The model is fitted on at most about ``TRAIN_ROWS`` labelled rows, drawn by a hash of the id: the documented bound. Counting is
distributed; the driver gets one number per language and slot.

Null text, or text without a letter, is 'und' with score 0. Ties go to the language first in alphabetical order. Repeated rows
are judged alike. Without labelled rows everything is 'und'. An empty table gives no rows. Extra columns are
ignored by ``predict`` and kept by ``accepted``. Whole texts are scored, in blocks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, mix, remainder, slices_of, table, tidy

TRAIN_ROWS = 20_000
SLOTS = 1 << 16
KINDS = 4
BLOCK = 1 << 20
PENALTY = 10.0
#: A text in which no language has this share of the letters is rejected by ``accepted``.
LEAST_SHARE = 0.3

#: Scripts by UTF-8 lead byte: Latin 0, Greek 1, Cyrillic 2, Hebrew and Arabic 3, Indic and Thai 4, CJK and kana 5, Hangul 6, other 7.
SCRIPTS = 8
_SCRIPT = np.zeros(256, np.int8)
for _lo, _hi, _s in ((0xCD, 0xD0, 1), (0xD0, 0xD5, 2), (0xD5, 0xE0, 3), (0xE0, 0xE3, 4), (0xE3, 0xEA, 5), (0xEA, 0xEE, 6), (0xEE, 0x100, 7)):
    _SCRIPT[_lo:_hi] = _s
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Block:
    """Words of some lower-cased texts with their features: slots of kind k are k * SLOTS + hash."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b" " + b" ".join(texts) + b"    ", np.uint8)
        self.base = np.concatenate(([1], 1 + np.cumsum([len(x) + 1 for x in texts])))[:-1].astype(np.int64)
        inside = _LETTER[self.data]
        edge = np.flatnonzero(np.diff(inside.view(np.int8)))
        self.start, self.end = edge[0::2] + 1, edge[1::2] + 1
        self.text_of = np.searchsorted(self.base, self.start, "right") - 1
        self.size = self.end - self.start

    def slots(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions' word numbers' starts, slots) of each kind, ready for reduceat over words."""
        if not len(self.start):
            return
        # every word with the blank before it and the blank after it
        n = self.size + 1
        at = np.concatenate(([0], np.cumsum(n)))[:-1]
        place = np.repeat(self.start - 1 - at, n) + np.arange(int(n.sum()))
        code = self.data[place].astype(np.uint64)
        for k in range(1, KINDS):  # 2-, 3- and 4-grams from each place
            code = (code << np.uint64(8)) | self.data[place + k]
            yield at, ((k - 1) * SLOTS + (mix(code * np.uint64(2) + np.uint64(k)) >> np.uint64(48)).astype(np.int64))
        word = np.add.reduceat(mix(code + (place - np.repeat(self.start, n)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), at)
        yield np.arange(len(self.start)), (KINDS - 1) * SLOTS + (mix(word) >> np.uint64(48)).astype(np.int64)

    def scripts(self) -> np.ndarray:
        lead = np.where(_LETTER[self.data], _SCRIPT[self.data], 0)
        return np.maximum.reduceat(lead, self.start) if len(self.start) else np.zeros(0, np.int8)


def _lower(text: str) -> bytes:
    # U+0130 alone would become two characters
    return text.replace("\u0130", "i").lower().encode()


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        """counts: KINDS * SLOTS by language; scripts: SCRIPTS by language, numbers of words."""
        self.langs = langs
        table = counts.reshape(KINDS, SLOTS, len(langs)).astype(np.float64)
        table = np.log((table + 0.1) / (table.sum(1, keepdims=True) + 0.1 * SLOTS))
        self.table = (table - table.max(2, keepdims=True, initial=-np.inf)).reshape(KINDS * SLOTS, len(langs)).astype(np.float32)
        seen = scripts > 0.001 * scripts.sum(0, keepdims=True)  # of the language's words, so that a rare language keeps its script
        seen &= scripts > 0
        seen[~seen.any(1)] = True
        self.mask = np.where(seen, 0, -1e4).astype(np.float32)

    def scores(self, block: Block) -> np.ndarray:
        out = self.mask[block.scripts()].reshape(-1, len(self.langs)).copy()
        for at, slots in block.slots():
            got = np.add.reduceat(self.table[slots], at, axis=0)
            out += got / np.float32(KINDS - 1 if len(at) and len(slots) != len(at) else 1)
        return out


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every row of scores; sizes: numbers of rows of the sequences, one after the other."""
    labels = np.zeros(len(scores), np.int16)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    if not len(order):
        return labels
    first = (np.cumsum(sizes) - sizes)[order]
    size = sizes[order]
    live = len(order) - np.searchsorted(size[::-1], np.arange(size[0]), "right")  # sequences longer than t
    value = scores[first].astype(np.float64)
    moved: list[tuple[np.ndarray, np.ndarray]] = []
    for t in range(1, size[0]):
        old = value[: live[t]]
        best = old.argmax(1)
        change = old.max(1) - penalty
        switch = old < change[:, None]
        moved.append((best, switch))
        value[: live[t]] = np.where(switch, change[:, None], old) + scores[first[: live[t]] + t]
    state = value.argmax(1)
    for t in range(size[0] - 1, -1, -1):
        at = np.arange(live[t])
        labels[first[: live[t]] + t] = state[: live[t]]
        if t:
            best, switch = moved[t - 1]
            now = state[: live[t]]
            state[: live[t]] = np.where(switch[at, now], best, now)
    return labels


def learn(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """The model from the rows of docs with text and lang, at most about train_rows of them."""
    rows = docs.filter("text is not null and lang is not null")
    every = max(1, -(-rows.count() // train_rows))
    rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("lang", "text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(KINDS * SLOTS + SCRIPTS, np.int64))
        for batch in slices_of(batches):
            langs, texts = batch.column("lang").to_pylist(), [_lower(x.as_py()) for x in batch.column("text")]
            for lang in set(langs):
                own = [t for x, t in zip(langs, texts, strict=True) if x == lang]
                for lo, hi in blocks(own, BLOCK):
                    block = Block(own[lo:hi])
                    for _, slots in block.slots():
                        held[lang][:-SCRIPTS] += np.bincount(slots, minlength=KINDS * SLOTS)
                    held[lang][-SCRIPTS:] += np.bincount(block.scripts(), minlength=SCRIPTS)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(counts[at])], ["lang", "slot", "n"])

    sums = rows.mapInArrow(run, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(sums["lang"]))
    counts = np.zeros((KINDS * SLOTS + SCRIPTS, len(langs)))
    counts[sums["slot"].to_numpy(np.int64), sums["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)] = sums["n"]
    return Model(langs, counts[:-SCRIPTS], counts[-SCRIPTS:])


def label(texts: list[str], model: Model, penalty: float = PENALTY) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
    """(language, score, spans of (language, first code point, end)) of each text."""
    n = len(model.langs)
    scores, sizes, letters, spots, raw = [], np.zeros(len(texts), np.int64), [], [], [_lower(x) for x in texts]
    for lo, hi in blocks(raw, BLOCK):
        block = Block(raw[lo:hi])
        scores.append(model.scores(block) if n else np.zeros((len(block.start), 1), np.float32))
        sizes[lo:hi] = np.bincount(block.text_of, minlength=hi - lo)
        chars = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))  # code points before each byte
        letters.append(chars[block.end] - chars[block.start])
        home = chars[block.base[block.text_of]] if len(block.start) else chars[:0]
        spots.append(np.stack([chars[block.start] - home, chars[block.end] - home]))
    if not scores:
        return [("und", 0.0, []) for _ in texts]
    score, letter, spot = np.concatenate(scores), np.concatenate(letters), np.concatenate(spots, axis=1)
    labels = viterbi(score, sizes, penalty)
    out = []
    end = 0
    for text, size in zip(texts, sizes, strict=True):
        begin, end = end, end + int(size)
        if not n or not size or not any(map(str.isalpha, text)):
            out.append(("und", 0.0, []))
            continue
        own = labels[begin:end]
        share = np.bincount(own, weights=letter[begin:end], minlength=n)
        cut = np.flatnonzero(np.diff(own)) + 1
        spans = [(model.langs[own[a]], int(spot[0, begin + a]), int(spot[1, begin + b - 1])) for a, b in zip([0, *cut], [*cut, len(own)], strict=True)]
        out.append((model.langs[int(share.argmax())], float(share.max() / share.sum()), spans))
    return out


def _mapped(docs: DataFrame, model: Model, penalty: float, keep: float | None) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches):
            texts = [x.as_py() or "" for x in batch.column("text")]
            got = label(texts, held.value, penalty)
            if keep is not None:
                yield batch.filter(pa.array([x != "und" and s >= keep for x, s, _ in got], pa.bool_()))
                continue
            spans = pa.array([[{"lang": a, "lo": b, "hi": c} for a, b, c in x] for _, _, x in got], pa.list_(pa.struct([("lang", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _, _ in got], pa.string()), pa.array([x for _, x, _ in got], pa.float64()), spans], ["doc_id", "lang_pred", "score", "spans"])

    if keep is not None:
        return docs.mapInArrow(run, docs.schema)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double, spans array<struct<lang:string,lo:int,hi:int>>")


def predict(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score, spans of every row of docs."""
    return _mapped(docs, model, penalty, None)


def accepted(docs: DataFrame, model: Model, least_share: float = LEAST_SHARE, penalty: float = PENALTY) -> DataFrame:
    """The rows of docs whose language is known and holds at least least_share of the letters."""
    return _mapped(docs, model, penalty, least_share)


def training(docs: DataFrame) -> DataFrame:
    return docs.filter(remainder("doc_id", 5) != 0)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = predict(docs, learn(training(docs)))
    return got.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
