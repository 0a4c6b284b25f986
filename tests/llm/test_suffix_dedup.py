"""Induced sorting against plain sorting; removal of repeats against brute force over all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from sqlatlas.llm import induced, suffix_dedup


def common(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize(("held", "block", "base", "digits"), [(None, 1 << 19, 4 << 20, 2048), (0, 7, 0, 5), (60, 3, 4 << 20, 4), (200, 1 << 19, 0, 4)])
def test_suffixes_and_common_prefixes(held, block, base, digits, monkeypatch):
    """In memory and on disk, with the recursion and without."""
    for name, value in (("BLOCK", block), ("BASE", base), ("DIGITS", digits)):
        monkeypatch.setattr(induced, name, value)
    rng = np.random.default_rng(block)
    for _ in range(80):
        text = rng.integers(1, rng.integers(2, 6), rng.integers(0, 90))
        text = np.append(np.tile(text, rng.integers(1, 4)), 0).astype(np.uint16)
        order, shares = induced.suffix_order(text, 1000, held)
        raw = text.tolist()
        want = sorted(range(len(raw)), key=lambda i: raw[i:])
        assert list(order) == want
        assert list(shares) == [0] + [common(raw[a:], raw[b:]) for a, b in zip(want, want[1:])]
        _, capped = induced.suffix_order(text, 5, held)
        assert list(capped) == [min(5, x) for x in shares]


def test_the_scratch_takes_a_text_larger_than_its_memory():
    text = np.append(np.tile(np.random.default_rng(1).integers(1, 250, 40_000), 3), 0).astype(np.uint16)
    scratch = induced.Scratch(1 << 16)
    order, shares = induced.suffixes(text, 200, scratch, 256)
    assert scratch.spooled > 10 * len(text) and isinstance(order, np.memmap)
    assert sorted(order) == list(range(len(text))) and int((np.asarray(shares) == 200).sum()) == 2 * 40_000 - 199
    scratch.close()


def plain(texts, width=200):
    raw = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + width] for t in raw for i in range(len(t) - width + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]]) if t else b""
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("held", "hot"), [(256 << 20, 20_000), (1000, 3)])
def test_remove_repeats(spark, held, hot, monkeypatch):
    """Also with everything on disk and every 32-gram hot."""
    monkeypatch.setattr(induced, "HELD", held)
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", hot)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 8)))
    make = lambda n: " ".join(word() for _ in range(n))
    shared = [make(60) for _ in range(4)]
    texts = [None, "", "short", "a" * 199, "a" * 200, "b" * 201, "ab" * 150, "c" * 1000, make(3000)]
    texts += [make(rng.randint(0, 60)) + rng.choice(shared)[rng.randint(0, 40) :] + make(rng.randint(0, 90)) for _ in range(60)]
    texts += [shared[0][:199] + "x", make(20) + shared[1][:200] + make(20), shared[1][5:150] + shared[2][:150]]
    texts += [texts[9], texts[9], make(100) + "\0" + make(100)] + [make(80) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in enumerate(texts)], "doc_id long, text string, key string, marks int").repartition(3)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    for i, w in enumerate(plain(texts)):
        r = got[i]
        assert (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) == w, i
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    twice = docs.filter("doc_id = 8").union(docs.filter("doc_id = 8"))
    assert [len(r.kept) for r in suffix_dedup.remove_repeats(twice).collect()] == [0, 0]


def test_least_places_in_pieces():
    h = np.random.default_rng(2).integers(0, 9, 3000).astype(np.uint64) << np.uint64(40)
    want = [max(i + k for k in range(suffix_dedup.SPAN) if h[i + k] == h[i : i + suffix_dedup.SPAN].min()) for i in range(len(h) - suffix_dedup.SPAN + 1)]
    for most in (suffix_dedup.SPAN, 170, 400, 3000, 1 << 24):
        assert list(suffix_dedup.least_places(h, most)) == want


def test_repeat_beyond_16_mib(spark):
    rng = np.random.default_rng(5)
    text = rng.integers(97, 123, (1 << 24) + 5000).astype(np.uint8).tobytes().decode()
    low = (1 << 24) + 1000
    docs = spark.createDataFrame([(0, text), (1, "A" * 50 + text[low : low + 700] + "B" * 50)], "doc_id long, text string")
    got = {r.doc_id: [(s.lo, s.hi) for s in r.spans] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {0: [(low, low + 700)], 1: [(50, 750)]}


def test_many_repeated_rows(spark):
    """k equal rows share one key: its marks are told once, and every row gets them."""
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(7, text)] * 3000 + [(8, text + " more of it"), (9, "x" * 150)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 3002 and {(r.doc_id, len(r.kept), len(r.spans)) for r in got} == {(7, 0, 1), (8, 11, 1), (9, 150, 0)}


def test_common_prefixes_take_few_rounds(monkeypatch):
    rounds = []
    rng = np.random.default_rng(4)
    part = rng.integers(1, 5, 300)
    text = np.concatenate((part, [6], part, [7], part[:150], [8, 0])).astype(np.uint16)
    a, b = rng.integers(0, len(text), 4000), rng.integers(0, len(text), 4000)
    a[:300], b[:300] = np.arange(300), np.arange(300) + 301
    plain = [next((k for k in range(200) if max(x, y) + k >= len(text) or text[x + k] != text[y + k]), 200) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    known = np.minimum(plain, rng.integers(0, 3, 4000))
    monkeypatch.setattr(induced.np, "maximum", lambda x, y, f=np.maximum: (rounds.append(1), f(x, y))[1])
    got = induced.extended(text, a, b, known, 200)
    monkeypatch.undo()
    assert got.tolist() == plain and 0 < len(rounds) <= 12  # one for each symbol before


def test_range_minima():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 64, 100):
        x = rng.integers(0, 9, n).astype(np.uint16)
        lo, hi = (np.array(v) for v in zip(*[(i, j) for i in range(n) for j in range(i + 1, n + 1)], strict=True))
        assert induced.Minima(x).of(lo, hi).tolist() == [x[i:j].min() for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
