"""Toxicity by maximum-scoring segments.

Words (runs of letters, digits and non-ASCII characters, A-Z lower-cased) fall into ``BUCKETS``
hash buckets, so that what is learned and sent to the tasks has a fixed size. From labelled
documents outside the held-out fold the number of toxic and of clean documents with each
bucket gives a log-odds ratio with an informative Dirichlet prior (the bucket's share of all
labelled documents). A word scores its log-odds where it is significant, else 0, less a
constant drift, so that segments of ordinary text score below zero.

A linear scan finds all maximal scoring segments of the whole text. Their scores are
calibrated by extreme-value statistics: lambda solves sum p(s) exp(lambda s) = 1 over the word
scores of clean text, K is fitted to the number of segments seen there, and a segment of score
S in n words has evidence lambda S - ln(K n), the negative log of its expected count. Segments
of positive evidence are significant; their evidence is summed, and a logistic curve over this
sum, the best segment and the share of words in significant segments gives the probability.
The counts are taken over all labelled documents outside the fold; calibration and curve are
fitted on ``limit`` of them (a parameter). What reaches the driver is a count for each bucket, a
histogram of segment scores in steps of a hundredth of their logarithm, and three numbers for
each document of the sample.

Defined results: texts without words have no segment and score by the curve at zero evidence.
Without labelled rows of both classes every score is the smoothed share of label 1. Repeated
and NULL ids are scored by row; a column of the result's name is replaced."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadweave.llm.common import ALPHANUMERIC, run_starts, span_hashes, text_pieces, word_spans
from leadweave.llm.labelled import training_rows, training_sample

BUCKETS = 1 << 18
LIMIT = 20_000
DRIFT = 0.5
HIGHEST = 6.0
PRIOR_WEIGHT = 50.0
LEAST_Z = 3.0
_EVIDENCE = T.StructType([
    T.StructField("evidence", T.DoubleType()), T.StructField("best", T.DoubleType()),
    T.StructField("share", T.DoubleType()), T.StructField("n_words", T.LongType()),
    T.StructField("segments", T.ArrayType(T.StructType([
        T.StructField("first_word", T.IntegerType()), T.StructField("end_word", T.IntegerType()),
        T.StructField("score", T.DoubleType())])))])


def maximal_segments(first: list[int], end: list[int], before: list[float], after: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, from the words of positive score: their position, the end
    of the position, and the running total of scores before and after each. Candidates stay in
    a list, each with the place of the nearest one before it that starts lower; a new word
    joins back over candidates it outgrows. Every candidate is joined once: linear time."""
    found: list[tuple[int, int, float, float, int]] = []
    for a, b, low, high in zip(first, end, before, after, strict=True):
        place = len(found) - 1
        while True:
            while place >= 0 and found[place][2] >= low:
                place = found[place][4]
            if place < 0 or found[place][3] >= high:
                found.append((a, b, low, high, place))
                break
            a, _, low, _, earlier = found[place]
            del found[place:]
            place = earlier
    return [(a, b, high - low) for a, b, low, high, _ in found]


def word_scores(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Scores by bucket from document counts: log-odds with Dirichlet prior, drift taken off."""
    alpha = PRIOR_WEIGHT * (toxic + clean + 0.01) / (n_toxic + n_clean + 0.01)
    total = PRIOR_WEIGHT
    a, b = toxic + alpha, clean + alpha
    rest_a, rest_b = np.maximum(n_toxic + total - a, 0.5), np.maximum(n_clean + total - b, 0.5)
    odds = np.log(a / rest_a) - np.log(b / rest_b)
    z = odds / np.sqrt(1 / a + 1 / b)
    return np.where(z >= LEAST_Z, np.minimum(odds, HIGHEST), np.where(z <= -LEAST_Z, np.maximum(odds, -1.0), 0.0)) - DRIFT


def tail_rate(scores: np.ndarray, share: np.ndarray) -> float:
    """lambda > 0 with sum share * exp(lambda * score) = 1, by bisection."""
    if scores.max() <= 0:
        return 1.0
    low, high = 1e-6, 1.0
    def over(x: float) -> bool:
        return float((share * np.exp(x * scores)).sum()) > 1
    while not over(high):
        high *= 2
        if high > 64:
            return 64.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if over(middle) else (middle, high)
    return high


@dataclass
class SegmentModel:
    scores: np.ndarray
    rate: float = 1.0
    log_k: float = 0.0
    curve: np.ndarray | None = None
    prior: float = 0.5

    def segments(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Words and maximal segments (first word, end word, score) of every row."""
        starts, ends, first = word_spans(data, bounds, ALPHANUMERIC)
        bucket = (span_hashes(data, starts, ends, lower=True) & np.uint64(BUCKETS - 1)).astype(np.int64)
        score = self.scores[bucket].astype(np.float64)
        total = np.append(0, np.cumsum(score))
        at = np.flatnonzero(score > 0)
        row = np.searchsorted(first, at, "right") - 1
        cuts = np.searchsorted(row, np.arange(len(first)))
        out = []
        for k in range(len(first) - 1):
            mine = at[cuts[k] : cuts[k + 1]]
            out.append(maximal_segments(
                (mine - first[k]).tolist(), (mine - first[k] + 1).tolist(), total[mine].tolist(), total[mine + 1].tolist()) if len(mine) else [])
        return np.diff(first), out

    def evidence(self, n_words: int, segments: list[tuple[int, int, float]]) -> tuple[float, float, float, list]:
        base = self.log_k + np.log(max(n_words, 1))
        worth = [(self.rate * s - base, a, b, s) for a, b, s in segments]
        strong = [x for x in worth if x[0] > 0]
        return (float(sum(x[0] for x in strong)), float(max((self.rate * x[2] for x in segments), default=0.0)),
                sum(x[2] - x[1] for x in strong) / max(n_words, 1), [x[1:] for x in strong])

    def known(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list]]:
        """Of every row evidence, best, share (rows, 3), words, and significant segments."""
        n, found = self.segments(data, bounds)
        each = [self.evidence(int(k), s) for k, s in zip(n, found, strict=True)]
        return np.array([x[:3] for x in each]).reshape(-1, 3), n, [x[3] for x in each]

    def probability(self, evidence: np.ndarray, best: np.ndarray, share: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(evidence), self.prior)
        return 1 / (1 + np.exp(-np.clip(_curve_inputs(evidence, best, share) @ self.curve, -40, 40)))


def _curve_inputs(evidence: np.ndarray, best: np.ndarray, share: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(evidence)), np.log1p(evidence), np.log1p(best), np.sqrt(share)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for a logistic curve with a small ridge."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _counts(sample: DataFrame) -> DataFrame:
    """bucket, toxic and clean documents with it, words of clean text in it; bucket -1 counts
    the documents. Each task adds up its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((3, BUCKETS), np.int64)
        totals = np.zeros(3, np.int64)
        for batch in batches:
            for rows, data, bounds in text_pieces(batch, "text"):
                toxic = rows.column("label").to_numpy() > 0
                starts, ends, first = word_spans(data, bounds, ALPHANUMERIC)
                bucket = (span_hashes(data, starts, ends, lower=True) & np.uint64(BUCKETS - 1)).astype(np.int64)
                row = np.repeat(np.arange(len(toxic)), np.diff(first))
                table[2] += np.bincount(bucket[~toxic[row]], minlength=BUCKETS)
                seen = np.sort(row * BUCKETS + bucket)
                seen = seen[run_starts(seen)]
                row, bucket = seen // BUCKETS, seen % BUCKETS
                table[0] += np.bincount(bucket[toxic[row]], minlength=BUCKETS)
                table[1] += np.bincount(bucket[~toxic[row]], minlength=BUCKETS)
                totals += [toxic.sum(), (~toxic).sum(), 0]
        at = np.flatnonzero(table.any(axis=0))
        yield pa.record_batch([pa.array(np.append(at, -1)), *(
            pa.array(np.append(table[k][at], totals[k])) for k in range(3))], ["bucket", "toxic", "clean", "words"])

    return sample.mapInArrow(run, "bucket long, toxic long, clean long, words long").groupBy("bucket").agg(
        *[F.sum(c).alias(c) for c in ("toxic", "clean", "words")])


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 5, which: int = 0, limit: int = LIMIT, text_col: str = "text") -> SegmentModel:
    """Counts by bucket over all labelled rows; then two passes over a sample of them: how high
    segments of clean text score, and what evidence each document gives at that."""
    counts = _counts(training_rows(docs, labels, label_col, folds, which, text_col)).toPandas()
    totals = counts[counts["bucket"] < 0]
    counts = counts[counts["bucket"] >= 0]
    n_toxic, n_clean = int(totals["toxic"].sum()), int(totals["clean"].sum())
    prior = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
    by_bucket = np.zeros((3, BUCKETS))
    by_bucket[:, counts["bucket"].to_numpy()] = counts[["toxic", "clean", "words"]].to_numpy().T
    model = SegmentModel(word_scores(by_bucket[0], by_bucket[1], n_toxic, n_clean).astype(np.float32), prior=prior)
    if not n_toxic or not n_clean:
        return model
    share = by_bucket[2] / max(by_bucket[2].sum(), 1)
    model.rate = tail_rate(model.scores.astype(np.float64), share)
    sample = training_sample(docs, labels, label_col, folds, which, limit, text_col)
    usual = _usual_scores(sample, model).toPandas().sort_values("step")
    words = int(usual.loc[usual["step"] == _WORDS, "n"].sum())
    usual = usual[usual["step"] != _WORDS]
    if len(usual):
        # K from how often clean text reaches about the median score of its segments
        reaching = usual["n"].to_numpy()[::-1].cumsum()[::-1]
        middle = int(np.flatnonzero(2 * reaching >= reaching[0])[-1])
        model.log_k = float(np.log(reaching[middle] / max(words, 1)) + model.rate * np.exp(usual["step"].iloc[middle] / 100))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in text_pieces(batch, "text"):
                known = model.known(data, bounds)[0]
                yield pa.record_batch({"label": rows.column("label"), **{f"k{i}": pa.array(known[:, i]) for i in range(3)}})

    got = sample.mapInArrow(run, "label int, k0 double, k1 double, k2 double").toPandas().sort_values(["label", "k0", "k1", "k2"])
    model.curve = _logistic(_curve_inputs(*got[["k0", "k1", "k2"]].to_numpy().T), got["label"].to_numpy(np.float64))
    return model


_WORDS = -(1 << 30)


def _usual_scores(sample: DataFrame, model: SegmentModel) -> DataFrame:
    """step, n: how many segments of clean text score exp(step / 100) up to the next step; the
    step _WORDS counts its words. Each task adds up its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for rows, data, bounds in text_pieces(batch, "text"):
                clean = rows.column("label").to_numpy() == 0
                n, found = model.segments(data, bounds)
                seen[_WORDS] += int(n[clean].sum())
                worth = np.array([x[2] for k in np.flatnonzero(clean) for x in found[k]])
                steps, times = np.unique(np.floor(100 * np.log(np.maximum(worth, 1e-6))).astype(np.int64), return_counts=True)
                seen.update(dict(zip(steps.tolist(), times.tolist(), strict=True)))
        yield pa.record_batch([pa.array(list(seen.keys()), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["step", "n"])

    return sample.mapInArrow(run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, model: SegmentModel, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with a struct ``name``: score, evidence, best, share, n_words and the
    significant segments in words [first_word, end_word)."""
    kind = T.StructType([T.StructField("score", T.DoubleType()), *_EVIDENCE.fields])
    arrow = pa.struct([
        ("score", pa.float64()), ("evidence", pa.float64()), ("best", pa.float64()), ("share", pa.float64()),
        ("n_words", pa.int64()),
        ("segments", pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("score", pa.float64())])))])
    out = docs.drop(name).withColumn(name, F.lit(None).cast(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in text_pieces(batch, text_col):
                numbers, n, found = model.known(data, bounds)
                values = [
                    {"score": p, "evidence": e, "best": b, "share": s, "n_words": k,
                     "segments": [{"first_word": a, "end_word": z, "score": v} for a, z, v in strong]}
                    for p, (e, b, s), strong, k in zip(model.probability(*numbers.T).tolist(), numbers.tolist(), found, n.tolist(), strict=True)]
                yield rows.set_column(rows.schema.get_field_index(name), pa.field(name, arrow), pa.array(values, arrow))

    return out.mapInArrow(run, out.schema)
