import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from leadweave.llm import decontamination as D
from leadweave.llm.fm_index import FMIndex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, window=13):
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, passage in items:
            p = words(passage)
            n = min(len(p), window)
            for k in range(len(p) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == p[k : k + n]:
                        hit |= set(range(i, i + n))
                        if item is not None:
                            ids.add(str(item))
        out.append((doc, len(w), len(hit), sorted(ids)))
    return out


def test_fm_index_against_scan():
    rng = np.random.default_rng(1)
    for _ in range(60):
        text = np.append(rng.integers(0, 4, rng.integers(1, 120)), 0)
        index = FMIndex(text, sample_every=int(rng.integers(1, 6)))
        for n in (1, 2, 3, 5):
            phrases = rng.integers(1, 6, (20, n))
            found, low, high = index.search(phrases)
            got = {k: sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(found.tolist(), low, high, strict=True)}
            for k in range(20):
                assert got.get(k, []) == [i for i in range(len(text) - n + 1) if (text[i : i + n] == phrases[k]).all()]


def cases(prose):
    a, b = prose(10, 40), prose(11, 30)
    items = [(1, a), (2, b), (3, "Tiny Item"), (3, "tiny item"), (4, ""), (None, prose(12, 20)), (5, None), (11, a)]
    docs = [
        (1, prose(20, 30) + " " + a.upper() + " " + prose(21, 20)), (2, " ".join(words(b)[3:17])), (3, " ".join(words(b)[3:15])),
        (4, "x tiny, ITEM tiny item"), (5, prose(12, 20)), (6, None), (7, ""), (8, prose(22, 400)), (8, prose(22, 400)), (None, a), (9, a + " " + a)]
    return docs, items


def test_overlaps_against_brute_force(spark, prose, monkeypatch):
    docs, items = cases(prose)
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute(docs, items), key=str)
    for block in (1 << 20, 50):  # one block of phrases, or one pass per item
        got = [(r.doc_id, r.overlap.n_words, r.overlap.n_hit, r.overlap.items) for r in D.overlaps(df, bench, block_bytes=block).collect()]
        assert sorted(got, key=str) == want


def test_cut_spans_leaves_the_rest(spark, prose):
    a = prose(10, 40)
    df = spark.createDataFrame([(1, f"Vorher ä. {a} Nachher."), (2, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    out = D.overlaps(df, bench).select("doc_id", D.cut_spans(F.col("text"), F.col("overlap.spans")).alias("t")).collect()
    assert {r.doc_id: r.t for r in out} == {1: "Vorher ä.  Nachher.", 2: "clean"}


def test_odd_rows_and_empty_tables(spark, odd_docs, prose):
    bench = spark.createDataFrame([(1, prose(2, 60))], "item_id long, text string")
    kept = D.decontaminate(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 2
    assert D.decontaminate(odd_docs, bench.limit(0)).count() == odd_docs.count()
    assert D.decontaminate(odd_docs.limit(0), bench).count() == 0
    assert D.overlaps(odd_docs, bench).filter("overlap is null").count() == 0


def test_query_digest(spark, tmp_path, prose):
    from leadweave.llm.queries import QUERIES

    docs, items = cases(prose)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.n_words, r.n_hit, r.items_sha256, r.contaminated) for r in QUERIES["op1_decontamination"](spark, str(tmp_path)).collect()}
    assert got == {(d, n, h, hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0 and 20 * h >= n) for d, n, h, i in brute(docs, items)}
