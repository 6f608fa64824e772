import hashlib
import random
from collections import Counter

import numpy as np

from leadweave.llm import paragraph_sketch as S


def plain_likeness(a, b):
    """Multisets of paragraphs, without sketches."""
    x, y = (Counter(p for p in S.paragraphs((t or "").encode()) if p) for t in (a, b))
    total = x.total() + y.total()
    return 1.0 if not total else 1 - ((x - y).total() + (y - x).total()) / total


def test_paragraphs():
    cut = lambda t: [p for p in S.paragraphs(t.encode()) if p]
    assert cut("One. Two! Three?\n\n  Four  \n \t\n") == [b"One.", b"Two!", b"Three?", b"Four"]
    assert cut("") == cut(" \n ") == []
    assert cut("3.5 a.b") == [b"3.5 a.b"]
    same = " ".join(["word"] * 400)
    assert max(len(p.split()) for p in cut(same)) <= S.LONG and len(cut(same)) >= 25
    long = "x" * 1000
    assert b"".join(cut("a " + long + " b")) == b"a" + long.encode() + b"b"
    rng = random.Random(1)
    words = [str(rng.randrange(500)) for _ in range(900)]
    before, after = cut(" ".join(words)), cut(" ".join(["new", "head", *words]))
    assert len(set(before) & set(after)) > 0.9 * len(set(before))


def keys_of(rng, n):
    return np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)


def test_sketches_give_up_the_difference():
    rng = random.Random(7)
    pairs = []
    for common, a, b in [(0, 0, 0), (5, 0, 0), (0, 1, 0), (30, 2, 3), (400, 60, 0), (0, 300, 500), (2000, 5, 5)]:
        shared, only_a, only_b = keys_of(rng, common), keys_of(rng, a), keys_of(rng, b)
        pairs.append((np.r_[shared, only_a], np.r_[shared, only_b], set(only_a.tolist()), set(only_b.tolist())))
    flat = [(np.concatenate([p[s] for p in pairs]), np.repeat(np.arange(len(pairs)), [len(p[s]) for p in pairs])) for s in (0, 1)]
    keys, rows, side, cells = S.differing(*flat, len(pairs))
    for r, (_, _, a, b) in enumerate(pairs):
        mine = rows == r
        assert set(keys[mine & (side == 1)].tolist()) == a and set(keys[mine & (side == -1)].tolist()) == b and mine.sum() == len(a) + len(b)
    assert cells[0] == cells[1] == S.CELLS and cells[5] >= 1.2 * 800 and all(c % S.TABLES == 0 for c in cells)


def test_likeness_against_multisets(spark, prose):
    rng = random.Random(3)
    texts = [prose(k, 20 + 40 * k) for k in range(12)] + [None, "", " \n", "same. same. same.", "x " * 3000, prose(40, 20_000)]
    rows = [(k, rng.choice(texts), rng.choice(texts), "own") for k in range(60)] + [(100, texts[3], texts[3] + "\nmore", "own"), (101, "a. b. a.", "a. b.", "own")]
    df = spark.createDataFrame(rows, "id int, a string, b string, given string").repartition(3)
    got = {r.id: r for r in S.compare(df, "a", ["b"]).select("given.id", "given.given", "print0", "print1", "against1").collect()}
    assert len(got) == len(rows)
    for k, a, b, _ in rows:
        r = got[k]
        assert abs(r.against1.likeness - plain_likeness(a, b)) < 1e-12 and r.given == "own"
        assert (r.print0 == r.print1) == (plain_likeness(a, b) == 1.0)
        assert len(r.against1.only_left) - len(r.against1.only_right) == r.against1.n_left - r.against1.n_right
    empty = S.compare(df.limit(0), "a", ["b"])
    assert empty.count() == 0 and len(got[0].print0) == 32 * S.CELLS


def chain(rows):
    """[(id, text, text of the next row)] in descending order."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    return [(a[0], a[1], b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True)]


def test_next_document(spark):
    rng = random.Random(5)
    ids = rng.sample(range(10**6), 300)
    rows = [(i, f"text {i}") for i in ids]
    for buckets in (1, 7, 40):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
        got = [(r[0], r[1], r[2]) for r in S.with_next(df, buckets=buckets).select("given.doc_id", "text", "following").collect()]
        assert sorted(got) == sorted(chain(rows)), buckets
    names = [(f"id{i:07d}é", t) for i, t in rows]
    df = spark.createDataFrame(names, "doc_id string, text string")
    got = [tuple(r) for r in S.with_next(df, buckets=9).select("given.doc_id", "text", "following").collect()]
    assert sorted(got) == sorted(chain(names))


def test_next_of_odd_rows(spark, odd_docs):
    out = S.with_next(odd_docs, buckets=5)
    assert out.count() == odd_docs.count() and out.select("given.*").columns == [c for c in odd_docs.columns if c != "text"]
    assert S.with_next(odd_docs.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "only")], "doc_id long, text string")
    assert S.with_next(one).select("following").first()[0] == "only"
    nameless = spark.createDataFrame([(None, f"t{k}") for k in range(30)] + [(5, "five"), (6, None)], "doc_id long, text string")
    got = [tuple(r) for r in S.with_next(nameless, buckets=4).select("given.doc_id", "text", "following").collect()]
    assert Counter(x[1] for x in got) == Counter(x[2] for x in got)  # a ring: every row follows one
    assert (6, None, "five") in got and len(got) == 32


def test_query_columns(spark, odd_docs, tmp_path):
    from leadweave.llm.queries import op12_paragraph_sketch

    rows = [(3, "aaaa bbbb. cccc dddd."), (2, "ünï çödé 😀!"), (1, None), (0, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op12_paragraph_sketch(spark, str(tmp_path)).collect()}
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, following = text or "", following or ""
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == plain_likeness(text, edited) and r.near_next == plain_likeness(text, following)
