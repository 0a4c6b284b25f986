"""The Jaccard join against brute force over all pairs."""

import hashlib
import random
import re

import numpy as np
import pytest
from sqlatlas.llm import ngram_join


def plain(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = 0
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                links += a != b
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [(len(s), root(i)) for i, s in enumerate(sets)], links


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "É"]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    hot = make(30)
    texts = [None, "", " \n", "a", "A", "a b c d", "a b c D", "a b c d e", "a b c d e f", "x" * 4000, "a b c d e\x0bf"]
    for _ in range(12):  # groups of near copies, chains included
        base = make(rng.choice([8, 20, 60, 150]))
        for _ in range(rng.choice([2, 3, 30])):
            own = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 40)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            if rng.random() < 0.3:
                base = own
            texts.append(" ".join(own))
    texts += [" ".join(hot + make(rng.randint(1, 12))) for _ in range(60)]  # one passage in all of them
    texts += [" ".join(make(rng.randint(1, 80))) for _ in range(60)] + [texts[20], texts[25]]
    return texts


@pytest.mark.parametrize(("seed", "shard"), [(1, 8192), (2, 7)])
def test_classes(spark, seed, shard, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHARD", shard)
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, n long, sig string, size int").repartition(3)
    want, _ = plain(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want})


@pytest.mark.parametrize("block", [4 << 20, 3000])
def test_links_of_near_copies(spark, block, monkeypatch):
    """All links between different sets are counted, those inside a component too."""
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", block)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:i], "new", *base[i + 1 :]]) for i in range(60)] + ["a b c d e f", "other words"] + corpus(3)[11:60]
    texts.append(texts[0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)))) if len(t.split()) >= 5 else frozenset([t]) for t in texts]
    near = lambda a, b: a != b and 100 * len(a & b) >= 75 * len(a | b)
    want = [sum(near(a, b) for b in set(sets)) for a in sets]
    assert {r.doc_id: r.n_links for r in ngram_join.jaccard_classes(docs).collect()} == dict(enumerate(want)) and want[0] == 59


@pytest.mark.parametrize("cost", [0, 1, 64, 1 << 30])
def test_links_by_matrices(cost, monkeypatch):
    """Dense columns, pairs, and both."""
    monkeypatch.setattr(ngram_join, "PAIR_COST", cost)
    monkeypatch.setattr(ngram_join, "COLUMNS", 7)
    rng = np.random.default_rng(cost % 97)
    sets = [np.unique(rng.integers(0, rng.choice([12, 400]), rng.integers(1, 30))).astype(np.uint64) for _ in range(60)]
    near = lambda a, b: 4 * len(np.intersect1d(a, b)) >= 3 * len(np.union1d(a, b))
    inner, _ = ngram_join.linked(sets, None)
    assert list(inner) == [sum(near(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    x, y = ngram_join.linked(sets[:25], sets[25:])
    assert list(x) == [sum(near(a, b) for b in sets[25:]) for a in sets[:25]] and list(y) == [sum(near(a, b) for a in sets[:25]) for b in sets[25:]]


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (9, None)], "doc_id long, text string")
    assert ngram_join.jaccard_classes(docs.limit(0)).count() == 0
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(docs).collect())
    assert got == [("3", 2, 3), ("3", 2, 3), ("9", 0, 9), ("None", 2, 3)]


def test_one_row_of_each_component(spark):
    """Rows are known by id and text: null and repeated ids lose nothing that is unique, and no copy stays."""
    a, b, near = " ".join(f"a{i}" for i in range(60)), "some other words that stand alone here", " ".join(f"a{i}" for i in range(61))
    rows = [(1, a), (5, a), (5, b), (None, a), (None, near), (None, "a null id of its own text"), (7, b), (7, b), (9, near), (9, near), (8, None), (8, None), (8, " "), (1, near), (None, "a null id of its own text")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, sha string, kept int").repartition(4)
    got = ngram_join.one_of_each(docs)
    first = min(a, near, key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    want = [(1, first), (5, b), (None, "a null id of its own text"), (8, None), (8, None), (8, " ")]
    assert got.columns == docs.columns and sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))


def test_tree_loses_nothing():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 60, 500)
    points = np.stack([np.bincount(rng.integers(0, 64, s), minlength=64) for s in sizes])
    points[100:140] = points[100]
    sizes[100:140] = sizes[100]
    tree = ngram_join.Tree(points, sizes)
    for i in range(0, 500, 7):
        bound = np.minimum(points, points[i]).sum(1)
        want = np.flatnonzero(ngram_join.fits(sizes, sizes[i]) & (bound >= ngram_join.needed(sizes, sizes[i])))
        assert sorted(tree.search(points[i], int(sizes[i]))) == list(want)


@pytest.mark.parametrize("most", [1_000_000, 7])
def test_components(spark, most, monkeypatch):
    from sqlatlas.llm import components

    monkeypatch.setattr(components, "EDGES_A_TASK", most)
    rng = random.Random(most)
    edges = [(rng.randint(-60, 60), rng.randint(-60, 60)) for _ in range(50)] + [(i, i + 1) for i in range(100, 130)] + [(5, 5)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert {k: got.get(k, k) for k in label} == label
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
