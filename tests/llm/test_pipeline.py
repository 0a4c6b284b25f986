"""The pipeline against brute force on a small fixture, and its stages' contracts."""

import re

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
from test_first_ops import brute_overlap, norm
from test_ngram_join import plain

EN = "the quick brown fox jumps over the lazy dog and runs away from all of them".split()
DE = "der schnelle braune fuchs springt über den faulen hund und läuft weg von ihnen".split()


def fixture(folder):
    texts = []
    for i in range(40):
        words = EN if i % 3 else DE
        texts.append(" ".join(words[(i * 7 + k * (i % 5 + 1)) % len(words)] + (str(i) if k % 4 == 0 else "") for k in range(30 + i)))
    texts += [texts[3], texts[3].replace(" ", "  "), texts[4] + " extra", "12 34 !!", None, ""]
    item = "one two three four five six seven eight nine ten eleven"
    texts += [texts[5] + " ONE, two three four five six seven eight nine ten!", texts[6] + " one two three"]
    n = len(texts)
    docs = pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": texts, "lang": ["en" if i % 3 else "de" for i in range(n)], "source": ["s"] * n, "n_chars": pa.array([len(t or "") for t in texts], pa.int64())})
    pq.write_table(docs, f"{folder}/documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": [item]}), f"{folder}/benchmark.parquet")
    return texts, [(1, item)]


def test_ids_that_repeat_or_lack(spark, tmp_path):
    """Every unique text stays under its own row, whatever its id; of copies one row stays."""
    texts = [" ".join(f"{w}{k}" for w in EN) for k in range(6)]
    rows = [(1, texts[0]), (5, texts[0]), (5, texts[1]), (None, texts[0]), (None, texts[2]), (None, texts[3]), (7, texts[4]), (7, texts[4]), (7, texts[5])]
    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows], "lang": ["en"] * 9, "source": ["s"] * 9, "n_chars": [len(t) for _, t in rows]}, kinds), f"{tmp_path}/documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": ["nothing of this is in any document"]}), f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, [1, 5, None, None, 7, 7]))


def test_pipeline(spark, tmp_path):
    texts, items = fixture(tmp_path)
    kept = [i for i, t in enumerate(texts) if re.search(r"[^\W\d_]", t or "")]
    first = {}
    for i in kept:
        first.setdefault(norm(texts[i]), i)
    kept = sorted(first.values())
    classes, _ = plain([texts[i] for i in kept])
    kept = [i for k, i in enumerate(kept) if classes[k][1] == k]
    kept = [i for i in kept if not brute_overlap(texts[i], items)[4]]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in got}) == kept and len(kept) < len(texts) - 6
    columns = spark.read.parquet(f"{tmp_path}/documents.parquet").columns
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
