import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadweave.llm import quality_attention as Q
from leadweave.llm import toxicity_segments as X
from leadweave.llm.labelled import held_out


def labelled(spark, prose, n=150):
    """Good prose against symbol spam and repeats; a third of the good texts hold slurs."""
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(n):
        text, quality, toxic = prose(1000 + k, rng.choice([40, 90, 300])), 1, 0
        if k % 4 == 0:
            text, quality = rng.choice([" ".join(w + "###$$" for w in text.split()), " ".join(["spam"] * 80)]), 0
        elif k % 3 == 0:
            w = text.split(" ")
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vilest", "scumbag"]))
            text, toxic = " ".join(w), 1
        docs.append((k, text))
        labels.append((k, quality, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, column, fold):
    met = scored.join(labels, "doc_id").filter(held_out(F.col("doc_id"), *fold))
    return met.agg(F.avg(((F.col("p") >= 0.5) == (F.col(column) == 1)).cast("int"))).first()[0]


def test_quality_learns_from_labels(spark, prose):
    docs, labels = labelled(spark, prose)
    model = Q.learn(docs, labels)
    assert accuracy(Q.score(docs, model).withColumnRenamed("score", "p"), labels, "quality", (3, 1)) >= 0.95


def test_toxicity_learns_from_labels(spark, prose):
    docs, labels = labelled(spark, prose)
    model = X.learn(docs, labels)
    scored = X.score(docs, model).withColumn("p", F.col("toxicity.score"))
    assert accuracy(scored, labels, "toxic", (5, 0)) >= 0.95
    hit = scored.filter("p >= 0.5").first().toxicity
    assert hit.segments and hit.evidence > 0


def test_odd_rows_and_no_labels(spark, prose, odd_docs):
    docs, labels = labelled(spark, prose)
    none = labels.limit(0)
    bad = spark.createDataFrame([(None, 1, 1), (3, None, None), (3, None, None)], "doc_id long, quality int, toxic int")
    for train in (labels, none, bad):
        q = Q.score(odd_docs, Q.learn(docs, train))
        x = X.score(odd_docs, X.learn(docs, train))
        assert q.count() == x.count() == odd_docs.count()
        assert q.filter("score is null or score < 0 or score > 1").count() == 0
        assert x.filter("toxicity.score is null or toxicity.score < 0 or toxicity.score > 1").count() == 0
    assert Q.keep_good(odd_docs, none).columns == odd_docs.columns
    assert Q.keep_good(odd_docs.limit(0), labels).count() == 0


def test_attention_gradients():
    rng = np.random.default_rng(2)
    bags = [rng.normal(size=(n, Q.FEATURES)) for n in (1, 3, 5, 2)]
    y = np.array([0.0, 1, 1, 0])
    model = Q.fit(bags, y, epochs=2)
    x, first = np.concatenate(bags), np.array([0, 1, 4, 9, 11])

    def loss():
        p = model.forward(x, first)["score"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, grad in Q._gradients(model, x, first, y).items():
        at = tuple(rng.integers(0, s) for s in np.shape(grad))
        kept = np.array(model.weights[name])
        sides = []
        for step in (1e-5, -1e-5):
            model.weights[name] = kept.copy()
            model.weights[name][at] += step
            sides.append(loss())
        model.weights[name] = kept
        assert abs((sides[0] - sides[1]) / 2e-5 - grad[at]) < 1e-6


def plain_segments(scores):
    """Best segment, then what is left and right of it, by trying all; minimal in length."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > 0 and (best is None or (s, i - j) > (best[0], best[1] - best[2])):
                best = (s, i, j)
    if best is None:
        return []
    s, i, j = best
    return plain_segments(scores[:i]) + [(i, j, s)] + [(a + j, b + j, x) for a, b, x in plain_segments(scores[j:])]


@given(st.lists(st.integers(-5, 6), max_size=14))
def test_segments_against_recursion(scores):
    total = np.append(0, np.cumsum(scores)).tolist()
    at = [k for k, s in enumerate(scores) if s > 0]
    got = X.maximal_segments(at, [k + 1 for k in at], [total[k] for k in at], [total[k + 1] for k in at])
    assert sorted(s for *_, s in got) == sorted(s for *_, s in plain_segments(scores))
    assert all(total[b] - total[a] == s for a, b, s in got)


def test_tail_rate():
    scores, share = np.array([-1.0, 2.0]), np.array([0.9, 0.1])
    rate = X.tail_rate(scores, share)
    assert abs((share * np.exp(rate * scores)).sum() - 1) < 1e-9


def test_folds(spark):
    import zlib

    df = spark.createDataFrame([(k,) for k in range(50)] + [(None,)], "doc_id long")
    got = {r.doc_id: r.h for r in df.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("h")).collect()}
    assert got.pop(None) is False
    assert got == {k: zlib.crc32(str(k).encode()) % 5 == 0 for k in range(50)}
