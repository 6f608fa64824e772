import math
from collections import defaultdict

import numpy as np
import pytest

from leadweave.llm import mixing as M

LANGUAGE = {"en": "the of and to in is that for".split(), "de": "der die und den von zu das mit".split(), "fr": "le la les des et est que pour".split()}


def corpus(spark, n=90):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(n):
        lang = ["en", "en", "en", "de", "fr"][k % 5]
        rows.append((k, " ".join(rng.choice(LANGUAGE[lang], rng.integers(5, 60))), lang, lang))
    rows.append((n, "the of der die le la the der le", "en", "en"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def labels_of(docs):
    return docs.selectExpr("doc_id", "lang as domain").filter("doc_id % 2 = 0")


def test_rates_meet_targets(spark):
    docs = corpus(spark)
    goals = {"en": 0.3, "de": 0.3, "fr": 0.4}
    out = M.mix(docs, labels_of(docs), goals, keep=("doc_id", "lang"))
    totals = defaultdict(float)
    for r in out.collect():
        totals[r.domain] += r.rate * r.n_words
        assert r.rate >= 0 and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1)
        assert r.doc_id == 90 or r.domain == r.lang
    whole = sum(totals.values())
    assert all(abs(totals[d] / whole - g) < 0.01 for d, g in goals.items())
    rates = [r.rate for r in M.mix(docs, labels_of(docs), goals, keep_all=True).collect()]
    assert min(rates) == 1


def test_projected_gradient_against_plain_steps(spark):
    rng = np.random.default_rng(8)
    p = rng.dirichlet([0.4, 0.4, 0.4], 60)
    t = rng.integers(1, 50, 60)
    goal = np.array([0.7, 0.3, 0.0])
    rows = [(int(n), *map(float, x)) for n, x in zip(t, p, strict=True)]
    members = spark.createDataFrame(rows, "n_words long, p0 double, p1 double, p2 double")
    got = np.array([r[0] for r in members.select(M.fitted_rate(members, goal.tolist(), steps=4, tolerance=0.0)).collect()])
    weights = np.linalg.inv((t[:, None, None] * p[:, :, None] * p[:, None, :]).sum(0) / t.sum())
    rate, y = np.ones(60), np.ones(60)
    for along in range(4):
        off = (y[:, None] * t[:, None] * p).sum(0) / t.sum() - goal
        before, rate = rate, np.maximum(0, y - p @ (weights @ off))
        y = rate + along / (along + 3) * (rate - before)
    off = (rate[:, None] * t[:, None] * p).sum(0) / t.sum() - goal
    first = (t[:, None] * p).sum(0) / t.sum() - goal
    assert np.allclose(got, rate) and off @ weights @ off < 0.05 * (first @ weights @ first)


def test_passes_take_the_steps_since_the_last_table(spark, monkeypatch):
    rng = np.random.default_rng(9)
    p, t = rng.dirichlet([0.4, 0.4, 0.4], 60), rng.integers(1, 50, 60)
    rows = [(int(n), *map(float, x)) for n, x in zip(t, p, strict=True)]
    members = spark.createDataFrame(rows, "n_words long, p0 double, p1 double, p2 double")
    tables = []
    monkeypatch.setattr(M, "written", lambda df, name, write=M.written: tables.append(name) or write(df, name))
    goal = [0.9, 0.1, 0.0]
    with pytest.warns(UserWarning, match="targets are not met"):
        rate = M.fitted_rate(members, goal, steps=20, tolerance=0.0)
    assert tables == ["reached"]
    monkeypatch.setattr(M, "FOLD", 1000)
    with pytest.warns(UserWarning, match="targets are not met"):
        at_once = M.fitted_rate(members, goal, steps=20, tolerance=0.0)
    got = members.select(rate.alias("a"), at_once.alias("b")).collect()
    assert len(tables) == 1 and np.allclose([r.a for r in got], [r.b for r in got], rtol=1e-12)


def test_odd_rows(spark, odd_docs):
    docs = corpus(spark)
    goals = {"en": 1, "de": 1}
    out = M.mix(odd_docs, labels_of(docs), goals)
    assert out.count() == odd_docs.count() and out.filter("rate is null or copies is null").count() == 0
    kept = M.apply_mix(odd_docs, odd_docs.selectExpr("doc_id", "lang as domain"), goals, keep_all=True)
    assert kept.count() == odd_docs.count()
    assert set(odd_docs.columns) <= set(kept.columns)
    assert M.mix(odd_docs, labels_of(docs).limit(0), goals).count() == odd_docs.count()
    assert M.mix(odd_docs.limit(0), labels_of(docs), goals).count() == 0
    with pytest.raises(ValueError):
        M.mix(docs, labels_of(docs), {"en": 0})


@pytest.mark.parametrize("concentration", [6, 10, 30])
def test_soft_domains_meet_reachable_targets(spark, concentration):
    p = np.random.default_rng(1).dirichlet(np.full(4, concentration), 2000)
    rows = [(10, *map(float, x)) for x in p]
    members = spark.createDataFrame(rows, "n_words long, p0 double, p1 double, p2 double, p3 double").coalesce(1).cache()
    goal = [0.4, 0.2, 0.2, 0.2] if concentration < 30 else [0.3, 0.25, 0.25, 0.2]
    rate = np.array([r[0] for r in members.select(M.fitted_rate(members, goal)).collect()])
    assert rate.min() >= 0 and np.abs((rate[:, None] * p).mean(0) - goal).max() <= 2e-4


def test_targets_out_of_reach_are_named(spark):
    members = spark.createDataFrame([(10, 0.6, 0.4), (10, 0.4, 0.6), (20, 0.5, 0.5)], "n_words long, p0 double, p1 double")
    with pytest.warns(UserWarning, match="not met"):
        rate = [r[0] for r in members.select(M.fitted_rate(members, [0.9, 0.1])).collect()]
    assert rate[0] > 1 and rate[1] == 0  # the nearest that rates can come
