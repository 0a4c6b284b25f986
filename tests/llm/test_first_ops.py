"""Chat, exact dedup, decontamination, packing and token counts: against brute force, SQL and exact round trips."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sqlatlas.llm import chat, decontaminate, exact_dedup, packing, tokens
from tokenizers import Tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, body string, digest string, salt int"
AWKWARD = [None, "", " ", "a", "A  a", "a\t\na", "  lead", "trail  ", "x" * 5000, "é ß ü", "a\x1cb", "<|endoftext|> a <|endoftext|>", "don't stop", "a  b   c \n d\n\ne ", "1,234.5 + 6"]


def docs(spark, texts, first=0):
    return spark.createDataFrame([(i, t, "en", "s", 1, "clash", "clash", 0) for i, t in enumerate(texts, first)], DOCS)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("weak", [False, True])
def test_exact_classes(spark, weak):
    texts = AWKWARD * 3 + ["hot text"] * 200 + ["hot  text"]
    got = exact_dedup.exact_classes(docs(spark, texts), salts=5, **({"digest": lambda c: F.length(c).cast("string")} if weak else {})).collect()
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[norm(t)].append(i)
    want = {(i, min(g), len(g), i == min(g), hashlib.sha256(b.encode()).hexdigest()) for b, g in groups.items() for i in g}
    assert len(got) == len(texts) and {tuple(r) for r in got} == want
    kept = exact_dedup.drop_copies(docs(spark, texts), salts=3)
    assert kept.columns == docs(spark, []).columns and sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups.values())


def test_exact_repeated_rows_and_null_ids(spark):
    rows = docs(spark, ["a", "b"]).unionByName(docs(spark, ["a"])).unionByName(docs(spark, ["b"]).withColumn("doc_id", F.lit(None).cast("long")))
    got = sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_classes(rows).collect())
    assert got == [("0", 0, 2, True), ("0", 0, 2, True), ("1", 1, 2, True), ("None", 1, 2, False)]
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(rows).collect()) == [0, 1]
    assert exact_dedup.exact_classes(docs(spark, [])).count() == 0


def test_chat_round_trip(spark):
    bad = ["", None, "\\", "\\\\e", "</turn>", "</turn</turn>", "####", "\\###", "\n### user: x", "a: b\\c", "é</turn>\\h", "x" * 3000]
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a: b", "###", None]), rng.choice(bad), "extra") for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, None, None, None, "x"), (None, None, None, None, "x"), (99, 0, "user", "tie", "x"), (99, 0, "user", "tie", "x"), (99, 0, "assistant", "tie", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    want = defaultdict(list)
    for c, t, r, x, _ in rows:
        want[c].append((t if t is not None else -1, r or "", x or ""))
    for r in chat.parsed(chat.formatted(df)).collect():
        turns = [(role, text) for _, role, text in sorted(want[r.conv_id], key=lambda z: (z[0], z[1].encode(), z[2].encode()))]
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.loss_text == "".join(t.text for t in r.turns if t.role == "assistant")
        assert len(re.findall(r"(?:^|\n)### ", r.formatted)) == sum(1 for k, _ in itertools.groupby(turns, key=lambda z: z[0]))
    assert chat.formatted(df.limit(0)).count() == 0


def test_chat_ties_and_long_conversations(spark):
    """Rows of one turn and role sort by their raw texts; time is linear in turns."""
    texts = ["=", "</turn>", "###", "#", "\\", "[", "a", "A", ""]
    rows = [(1, 0, "user", t) for t in texts] + [(2, i, "assistant" if i % 2 else "user", f"text {i} é") for i in range(50_000)] + [(3, i, "assistant", "same role") for i in range(20_000)] + [(4, 0, "assistant", "é" * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    began = time.perf_counter()
    got = {r.conv_id: r for r in chat.parsed(chat.formatted(df)).collect()}
    assert time.perf_counter() - began < 60
    assert [t.text for t in got[1].turns] == sorted(texts)
    assert [t.text for t in got[2].turns] == [r[3] for r in rows if r[0] == 2]
    assert got[2].loss_text == "".join(r[3] for r in rows if r[0] == 2 and r[2] == "assistant")
    assert got[3].loss_text == "same role" * 20_000 and len(got[3].turns) == 20_000 and got[4].loss_text == "é" * 5000


def brute_overlap(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, named = set(), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        for win in {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else ():
            for i in range(len(words) - len(win) + 1):
                if tuple(words[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    named.add(str(item))
    return len(words), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)


def brute_longest(text, items):
    """(words, place, item, place in the item) of the longest match with one item; the first by place, then item, then place in it."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, best = split(text), (0, -1, "", -1)
    for item, t in items:
        own = split(t)
        least = min(10, len(own))
        for i in range(len(words)):
            for j in range(len(own)):
                k = 0
                while i + k < len(words) and j + k < len(own) and words[i + k] == own[j + k]:
                    k += 1
                if k and k >= least and (len(own) >= 10 or j == 0):
                    best = min(best, (-k, i, str(item), j))
    return -best[0], best[1], best[2] or None, best[3]


@pytest.mark.parametrize("slice_bytes", [1 << 20, 60])
def test_overlaps(spark, slice_bytes):
    rng = random.Random(1)
    vocab = "a b c dé É Z ab 12 ß".split()
    make = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", "", ",", "!"]) for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate([25, 12, 10, 4, 0])] + [(77, None), (5, "a,"), (1, make(11)), (9, "qq " * 10), (10, "zq")]
    texts = [None, "", "!!", "zq", "x" * 400 + " zq"] + [make(rng.randint(1, 40)) + " " + items[rng.randrange(3)][1] + make(rng.randint(0, 9)) for _ in range(30)] + ["q-q " * 30]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items if t != "a,"], "item_id long, text string, doc_id string")
    items = [x for x in items if x[1] != "a,"]
    texts += [f"{items[0][1]} {items[1][1]} {items[0][1]}", "qq " * 25, f"{items[1][1]} {items[1][1]}"]
    rows = decontaminate.overlaps(docs(spark, texts), bench, slice_bytes=slice_bytes).collect()
    got = {r.doc_id: tuple(r)[1:6] for r in rows}
    assert got == {i: brute_overlap(t, items) for i, t in enumerate(texts)}
    assert {r.doc_id: tuple(r)[6:] for r in rows} == {i: brute_longest(t, items) for i, t in enumerate(texts)}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(decontaminate, "MOST_TEST_BYTES", 10)
        with pytest.raises(ValueError, match="test set"):
            decontaminate.overlaps(docs(spark, texts), bench)
    clean = decontaminate.clean_documents(docs(spark, texts), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [i for i in got if not got[i][4]]
    assert decontaminate.overlaps(docs(spark, texts), bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.overlaps(docs(spark, []), bench).count() == 0


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = AWKWARD + ["".join(rng.choice(["ab", " ", "  ", "\n", "'s", "9", "é", ".", "　", "\x85", "中", "<|endoftext|>", "\t"]) for _ in range(40)) for _ in range(200)]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 1024), t
    assert tokens.count_tokens(docs(spark, []), path).count() == 0


def test_packing_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(3)
    texts = AWKWARD + ["".join(rng.choice(["ab", " ", "\n", "'s", "9", "é", "Σ", "é", "\x1d", "İ", "　", "<|startoftext|>"]) for _ in range(rng.randint(0, 400))) for _ in range(60)] + ["word " * 9000]
    frame = docs(spark, texts).unionByName(docs(spark, ["twice"], 3).limit(1)).unionByName(docs(spark, ["none", "big"]).withColumn("doc_id", F.when(F.col("doc_id") == 1, F.lit((1 << 62) + 1))))
    got = packing.pack_documents(frame, path).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want = [(k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
        assert sorted(pieces[i])[: len(want)] == want or i == 3, t
    assert {None, (1 << 62) + 1} <= set(pieces)
    check_places(got, 4096)
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= -(-total // 4096) + 1
    assert packing.pack_documents(docs(spark, []), path).count() == 0


def check_places(got, capacity):
    at = defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for rows in at.values():
        end = 0
        for offset, length in sorted(rows):
            assert offset == end
            end += length
        assert end <= capacity


def least_bins(sizes, capacity):
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                place(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(5)
    better = proven = 0
    for _ in range(150):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(1, 9))] if rng.random() < 0.5 else [rng.randint(20, 55) for _ in range(10)]
        got = packing.complete(sizes, 100, 20_000)
        assert sorted(i for b in got.bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 100 for b in got.bins)
        assert len(got.bins) == least_bins(sorted(sizes, reverse=True), 100)
        better += len(got.bins) < len(packing.best_fit(sizes, 100))
        proven += got.proven
    assert packing.complete([], 100) == ([], 0, True)
    assert proven > 100
    assert len(packing.complete([7, 6, 6, 4, 4, 3], 10).bins) == 3


def test_completion_beats_best_fit_in_a_group(spark):
    """Pieces of 44, 24, 22 and 10 hundredths of a sequence: best-fit decreasing needs more sequences than completion."""
    sizes = [1802, 1802, 983, 983, 901, 901, 410, 410] * 12 + [2049, 2000, 1400, 1350, 1300] * 7
    frame = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3)
    got = packing.packed(frame, 4096).collect()
    check_places(got, 4096)
    used = len({r.sequence_id for r in got})
    assert len(got) == len(sizes) and used < len(packing.best_fit(sizes, 4096)) and used - -(-sum(sizes) // 4096) <= 1
    assert all(r.nodes > 0 for r in got)


def test_bin_completion_ends_in_a_full_group():
    rng, sizes = random.Random(1), []
    while sum(sizes) < packing.GROUP_TOKENS:
        sizes += [rng.randint(500, 2500) for _ in range(100)]
    bins = packing.complete(sizes, packing.CAPACITY).bins
    assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= packing.CAPACITY for b in bins)
    assert len(bins) < len(packing.best_fit(sizes, packing.CAPACITY))


def test_other_tokenizers_go_to_the_library(spark):
    """The shortcuts hold for one way of splitting each; another tokenizer, without special strings or with a normalizer, is called on whole texts."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert tokens.cuts_at_blanks(open(path).read()) and not packing.splits_alike(open(path).read())
    other = public_tokenizers.path("word_bpe_49k.json")
    assert packing.splits_alike(open(other).read()) and not tokens.cuts_at_blanks(open(other).read())
    library = Tokenizer.from_file(other)
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs(spark, AWKWARD), other).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(AWKWARD)}
    library = Tokenizer.from_file(path)
    got = packing.tokenized(docs(spark, AWKWARD), path).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(AWKWARD)}
