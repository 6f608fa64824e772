"""Mixing sources to target weights by soft domain membership.

A naive Bayes classifier over ``BUCKETS`` hash buckets of words is fitted on a bounded sample
(``limit``, a parameter) of labelled documents (doc_id, domain) and gives every document
posteriors of the target domains. Rates r >= 0 per document are fitted by projected gradient
steps on the weighted least squares

    (m - w)' M^-1 (m - w) / 2,   m_d = sum_i r_i t_i p_id / T,   M = sum_i t_i p_i p_i' / T

with t_i the words of a document, T all words, m the expected shares of the domains and w their
targets. In the metric of the words the gradient is p_i . M^-1 (m - w), and its curvature is 1
in every direction that moves a share: the full step r_i <- max(least, r_i - p_i . M^-1 (m - w))
is safe and lands at once where no rate is clipped, however softly the classifier separates the
domains. Further steps, which settle what is clipped, start from a point that is carried on by
some of the way made before (Nesterov's acceleration, begun anew where it leads away). Steps end when the shares are met to
``tolerance`` or the projected gradient vanishes; targets out of reach are then met as nearly as
rates can, and named in a warning. A pass gives one number per domain; nothing else reaches the
driver. The steps are literals of the rate's expression, which is evaluated over the written
table of posteriors.

DataFrame functions only. Counting explodes words in place and sums them up per row before the
only shuffle, of one row per document.

Defined results: a text without words has the classifier's prior and rate as any other, but
moves no total. Domains are those of ``targets``; labelled rows of another domain or with NULLs
are not used. A domain that no document can belong to is left out of the fit. Without labelled
rows posteriors are uniform. Repeated rows have a rate each. Negative or all-zero targets are
an error. An empty table gives an empty result."""

from __future__ import annotations

import math
import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.llm.common import packed, unpacked, written

BUCKETS = 4096
LIMIT = 20_000
STEPS = 100
#: After so many steps the state of every row is written.
FOLD = 16
TOLERANCE = 1e-4
RESULT = ("mark", "n_words", "domain", "posterior", "rate", "copies")


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"\s+")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _table_of(values: list[float]) -> Column:
    """A constant array, folded by the optimizer."""
    return F.expr(f"cast(split('{','.join(f'{v:.9g}' for v in values)}', ',') as array<double>)")


def word_weights(docs: DataFrame, labelled: DataFrame, domains: list[str], text_col: str = "text", limit: int = LIMIT) -> tuple[list[list[float]], list[float]]:
    """Log-probabilities by domain and bucket, and log-priors, from at most ``limit`` labelled
    documents: the first in order of a hash of the id; the least domain of several for one id."""
    ids = (
        labelled.filter(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
        .groupBy("doc_id").agg(F.min("domain").alias("_domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    sample = docs.select("doc_id", F.col(text_col).alias("_text")).join(F.broadcast(ids), "doc_id")
    per_word = sample.select("_domain", F.explode(_words(F.col("_text"))).alias("w")).filter("w <> ''")
    counts = per_word.groupBy(_bucket(F.col("w")).alias("b")).agg(
        *[F.count_if(F.col("_domain") == d).alias(f"d{k}") for k, d in enumerate(domains)]).collect()  # BUCKETS rows at most
    sizes = sample.agg(*[F.count_if(F.col("_domain") == d).alias(f"d{k}") for k, d in enumerate(domains)]).first()
    weights, priors = [], []
    for k in range(len(domains)):
        seen = [0.5] * BUCKETS
        for r in counts:
            seen[r["b"]] += r[f"d{k}"]
        whole = sum(seen)
        weights.append([math.log(x / whole) for x in seen])
        priors.append(math.log((sizes[k] + 0.5) / (sum(sizes) + 0.5 * len(domains))))
    return weights, priors


def posteriors(docs: DataFrame, weights: list[list[float]], priors: list[float], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """given (struct of ``keep``), mark (hash of the text), n_words, and p0, p1, ...: one row per
    row."""
    word = F.col("_w")
    full = word.isNotNull() & (word != "")
    given = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("given"), F.xxhash64(text_col).alias("mark"),
        F.monotonically_increasing_id().alias("_row"), _words(F.col(text_col)).alias("_words"))
    exploded = given.select("given", "mark", "_row", F.explode_outer("_words").alias("_w")).withColumn("_b", F.when(full, _bucket(word)))
    scored = exploded.groupBy("_row", "given", "mark").agg(
        F.count("_b").alias("n_words"),
        *[F.coalesce(F.sum(F.get(_table_of(w), F.col("_b"))), F.lit(0.0)).alias(f"l{k}") for k, w in enumerate(weights)])
    logits = [F.col(f"l{k}") + F.lit(p) for k, p in enumerate(priors)]
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    shifted = scored.withColumns({f"e{k}": F.exp(x - top) for k, x in enumerate(logits)})
    every = _total([F.col(f"e{k}") for k in range(len(logits))])
    return shifted.select("given", "mark", "n_words", *[(F.col(f"e{k}") / every).alias(f"p{k}") for k in range(len(logits))])


def fitted_rate(members: DataFrame, goals: list[float], keep_all: bool = False, steps: int = STEPS, tolerance: float = TOLERANCE) -> Column:
    """The rate as an expression over p0, p1, ... With ``keep_all`` the token budget is as large
    as it takes to need no domain less than once, and steps are projected to rates of 1 or more;
    else it is the present number of tokens, and rates are 0 or more."""
    n = len(goals)
    p, words = [F.col(f"p{k}") for k in range(n)], F.col("n_words")
    places = [(i, j) for i in range(n) for j in range(i + 1)]
    first = members.agg(F.sum(words), *[F.sum(words * x) for x in p], *[F.sum(words * p[i] * p[j]) for i, j in places]).first()
    first = [float(x or 0) for x in first]
    total = first[0]
    if not total:
        return F.lit(1.0)
    now = np.array(first[1 : n + 1]) / total
    second = np.zeros((n, n))
    for (i, j), v in zip(places, first[n + 1 :], strict=True):
        second[i, j] = second[j, i] = v / total
    live = [k for k in range(n) if now[k] > 1e-12]
    weights = np.zeros((n, n))
    weights[np.ix_(live, live)] = np.linalg.pinv(second[np.ix_(live, live)], rcond=1e-10, hermitian=True)
    asked = sum(goals[k] for k in live)
    goal = np.array([goals[k] / asked if k in live and asked else 0.0 for k in range(n)])
    if keep_all and goal.any():
        goal = goal * max(now[k] / goal[k] for k in live if goal[k] > 0)
    least, steps_taken = 1.0 if keep_all else 0.0, []
    begin = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"), F.lit(0.0).alias("by"))

    def state(start: Column = begin, done: int = 0) -> Column:
        """All steps but the first ``done`` as one fold from the state after those, so that the plan
        keeps its size: the rate r, the point y that the next step starts from (r and some of the
        way it came), and how far r is from the point before, which is the projected gradient there."""
        if not steps_taken[done:]:
            return start

        def step(s: Column, g: Column) -> Column:
            r = F.greatest(F.lit(least), s["y"] - _total([p[k] * g[k] for k in range(n)]))
            return F.struct(r.alias("r"), (r + g[n] * (r - s["r"])).alias("y"), (r - s["y"]).alias("by"))

        return F.aggregate(F.array(*steps_taken[done:]), start, step)

    def distance(at: np.ndarray) -> float:
        return float((at - goal) @ weights @ (at - goal))

    ahead, along, reached, done = now, 0, members.withColumn("_s", begin), 0
    while np.abs(now - goal)[live].max(initial=0.0) > tolerance and len(steps_taken) < steps:
        if len(steps_taken) - done == FOLD:  # a pass takes the steps since, not all of them again
            reached = written(reached.select("n_words", *p, state(F.col("_s"), done).alias("_s")), "reached")
            done = len(steps_taken)
        steps_taken.append(F.array(*[F.lit(float(x)) for x in (*(weights @ (ahead - goal)), along / (along + 3))]))
        row = reached.withColumn("_s", state(F.col("_s"), done)).agg(
            *[F.sum(F.col(f"_s.{v}") * words * x) for v in ("r", "y") for x in p], F.sum(F.col("_s.by") * F.col("_s.by") * words)).first()
        before, sums = now, np.array([float(x or 0) for x in row]) / total
        now, ahead = sums[:n], sums[n : 2 * n]
        # momentum starts anew where it has led away from the targets
        along = along + 1 if distance(now) <= distance(before) else 0
        if sums[-1] <= (tolerance / 100) ** 2:
            break
    if np.abs(now - goal)[live].max(initial=0.0) > tolerance:
        missed = {k: (round(float(now[k]), 5), round(float(goal[k]), 5)) for k in live}
        warnings.warn(f"targets are not met: expected share and target by number of the domain {missed}", stacklevel=2)
    return state()["r"]


def mix(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
    keep_all: bool = False, limit: int = LIMIT,
) -> DataFrame:
    """``keep``, mark, n_words, domain (likeliest), posterior (of it), rate, copies: the rate
    rounded down or up by a hash of id and text, so that copies match it on average. These
    names replace equal ones of ``keep``."""
    return _rated(docs, labelled, targets, text_col, keep, keep_all, limit).select(
        *unpacked([c for c in keep if c not in RESULT]), *RESULT)


def _rated(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], text_col: str, keep: tuple[str, ...], keep_all: bool, limit: int) -> DataFrame:
    """given (struct of ``keep``) and RESULT."""
    domains = sorted(targets)
    if not domains or min(targets.values()) < 0 or sum(targets.values()) <= 0:
        raise ValueError("targets are weights of domains, not all of them zero")
    weights, priors = word_weights(docs, labelled, domains, text_col, limit)
    members = written(posteriors(docs, weights, priors, text_col, keep), "posteriors")
    rate = fitted_rate(members, [targets[d] for d in domains], keep_all)
    p = [F.col(f"p{k}") for k in range(len(domains))]
    best = F.greatest(*p) if len(p) > 1 else p[0]
    domain = reduce(lambda rest, k: F.when(p[k] == best, domains[k]).otherwise(rest), reversed(range(len(p))), F.lit(None))
    u = F.pmod(F.xxhash64(*[F.col("given").getField(c) for c in keep], "mark"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return members.withColumn("rate", F.round(rate, 9)).select(
        "given", "mark", "n_words", domain.alias("domain"), best.alias("posterior"), "rate",
        (F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long").alias("copies"))


def apply_mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], text_col: str = "text", keep_all: bool = False, limit: int = LIMIT) -> DataFrame:
    """``docs`` with domain, rate and copies in place of columns of these names; rows of no copy
    leave. Rates are met by id and hash of the text, which rows with equal rates share."""
    rates = _rated(docs, labelled, targets, text_col, ("doc_id",), keep_all, limit)
    table = written(
        rates.filter("copies > 0").select(F.col("given.doc_id").alias("of"), "mark", "domain", "rate", "copies")
        .dropDuplicates(["of", "mark"]), "rates")
    new = ["domain", "rate", "copies"]
    given = docs.select(packed(docs).alias("given"), F.col("doc_id").alias("own"), F.xxhash64(text_col).alias("own_mark"))
    met = given.join(table, F.col("own").eqNullSafe(F.col("of")) & (F.col("own_mark") == F.col("mark")))
    return met.select(*unpacked([c for c in docs.columns if c not in new]), *new)
