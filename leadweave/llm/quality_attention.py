"""Quality by attention over passages (multiple-instance learning).

A document is a bag of passages of ``PASSAGE`` words, all of its text. A passage is described
by shares of its bytes and words (symbols, digits, capitals, repeats, lengths), encoded by a
hidden layer, and weighted by gated attention: softmax over the passages of
w . (tanh(V h) * sigmoid(U h)). The weighted mean of the encodings is scored by a logistic
layer. Encoder, attention and output are learned together from document labels alone, on a
bounded sample of labelled rows (``limit`` documents of at most ``LONGEST`` passages; the
bound is a parameter), in numpy on the driver. Descriptions and scores are computed in Arrow
batches where the documents are; nothing is shuffled.

Defined results: a text without words (NULL, empty, blank) is one passage of zeros and is
scored like any other. Without labelled rows, or with one class only, every score is the
smoothed share of label 1, 0.5 with no labels at all. Rows are scored each; repeated and NULL
ids are no matter. A column with the name of the result is replaced, others pass through."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.llm.common import WHITESPACE, free_name, row_sums, span_hashes, text_pieces, word_spans
from leadweave.llm.labelled import training_sample

PASSAGE = 48
LONGEST = 2048
LIMIT = 6000


def _members(text: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(text.encode())] = True
    return table


_UPPER = _members("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_KINDS = {
    "symbols": _members("#*$%&<>@^~=+_\\{}[]"), "bars": _members("|"), "marks": _members("!?"),
    "stops": _members(".,;:"), "digits": _members("0123456789"), "capitals": _UPPER,
    "lines": _members("\n"),
}
_KINDS["beyond"] = np.arange(256) >= 128
FEATURES = len(_KINDS) + 8
WHITESPACE_NOT = ~WHITESPACE


def passages(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Descriptions (n passages, FEATURES) and the first passage of every row (n + 1)."""
    starts, ends, first = word_spans(data, bounds, WHITESPACE_NOT)
    count = np.diff(first)
    bags = np.maximum(1, -(-count // PASSAGE))
    bag_first = np.append(0, np.cumsum(bags))
    row = np.repeat(np.arange(len(count)), bags)
    low = first[row] + (np.arange(len(row)) - bag_first[row]) * PASSAGE
    high = np.minimum(low + PASSAGE, first[row + 1])
    edges = np.stack([low, high], 1)
    n = np.maximum(high - low, 1).astype(np.float64)

    def over_words(values: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(values, dtype=np.float64))
        return (total[edges[:, 1]] - total[edges[:, 0]]) / n

    if not len(starts):
        return np.zeros((len(row), FEATURES), np.float32), bag_first
    # bytes of a passage: from its first word to the first of the next one, or the row's end
    opens = np.where(count[row] > 0, starts[np.minimum(low, len(starts) - 1)], bounds[row])
    last = np.arange(len(row)) == bag_first[row + 1] - 1
    closes = np.where(last, bounds[row + 1], starts[np.minimum(high, len(starts) - 1)])
    size = np.maximum(closes - opens, 1)
    columns = []
    for member in _KINDS.values():
        total = np.append(0, np.cumsum(member[data], dtype=np.int64))
        columns.append((total[closes] - total[opens]) / size)
    hashes = span_hashes(data, starts, ends)
    passage = np.repeat(np.arange(len(row)), high - low)
    order = np.lexsort((hashes, passage))
    fresh = np.ones(len(order), np.float64)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    length = ends - starts
    columns += [
        over_words(fresh),  # ``fresh`` is in passage order, so its sums fall on the same bounds
        over_words(same), over_words(length) / 10, over_words(length <= 3),
        over_words(_UPPER[data[starts]]), over_words(_UPPER[data[ends - 1]]),
        np.log1p(np.minimum(high - low, PASSAGE)) / 4, np.log1p(count[row]) / 8,
    ]
    out = np.stack(columns, 1).astype(np.float32)
    out[count[row] == 0] = 0
    return out, bag_first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class AttentionModel:
    """Weights by name; ``prior`` stands in where nothing could be learned."""

    mean: np.ndarray
    scale: np.ndarray
    prior: float = 0.5
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = (x - self.mean) / self.scale
        hidden = np.maximum(x @ w["encode"] + w["encode_b"], 0)
        u, g = np.tanh(hidden @ w["v"]), _sigmoid(hidden @ w["u"])
        raw = (u * g) @ w["attend"]
        raw = raw - np.repeat(np.maximum.reduceat(raw, first[:-1]), np.diff(first))
        attention = np.exp(raw)
        attention /= np.repeat(row_sums(attention, first), np.diff(first))
        bag = row_sums(attention[:, None] * hidden, first)
        return {"x": x, "hidden": hidden, "u": u, "g": g, "attention": attention, "bag": bag,
                "score": _sigmoid(bag @ w["out"] + w["out_b"])}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)["score"] if self.weights else np.full(len(first) - 1, self.prior)


def _gradients(model: AttentionModel, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    w, f = model.weights, model.forward(x, first)
    bag = np.repeat(np.arange(len(y)), np.diff(first))
    logit = (f["score"] - y) / len(y)
    per_bag = logit[:, None] * w["out"]
    a, hidden, u, g = f["attention"], f["hidden"], f["u"], f["g"]
    d_a = (hidden * per_bag[bag]).sum(1)
    d_raw = a * (d_a - np.repeat(row_sums(a * d_a, first), np.diff(first)))
    d_u = d_raw[:, None] * w["attend"] * g * (1 - u * u)
    d_g = d_raw[:, None] * w["attend"] * u * g * (1 - g)
    d_hidden = (a[:, None] * per_bag[bag] + d_u @ w["v"].T + d_g @ w["u"].T) * (hidden > 0)
    return {"out": f["bag"].T @ logit, "out_b": logit.sum(), "attend": (u * g).T @ d_raw,
            "v": hidden.T @ d_u, "u": hidden.T @ d_g,
            "encode": f["x"].T @ d_hidden, "encode_b": d_hidden.sum(0)}


def fit(bags: list[np.ndarray], y: np.ndarray, hidden: int = 16, gate: int = 8, epochs: int = 40, batch: int = 128, seed: int = 3) -> AttentionModel:
    """Adam over shuffled batches of bags; deterministic for given bags."""
    if len(y) == 0 or y.min() == y.max():
        return AttentionModel(np.zeros(FEATURES), np.ones(FEATURES), float((y.sum() + 0.5) / (len(y) + 1)))
    every = np.concatenate(bags).astype(np.float64)
    rng = np.random.default_rng(seed)

    def start(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

    model = AttentionModel(every.mean(0), every.std(0) + 1e-3, weights={
        "encode": start(FEATURES, hidden), "encode_b": np.zeros(hidden), "v": start(hidden, gate),
        "u": start(hidden, gate), "attend": start(gate), "out": start(hidden), "out_b": np.zeros(())})
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for k in range(0, len(order), batch):
            chosen = order[k : k + batch]
            x = np.concatenate([bags[i] for i in chosen]).astype(np.float64)
            first = np.append(0, np.cumsum([len(bags[i]) for i in chosen]))
            step += 1
            for name, grad in _gradients(model, x, first, y[chosen]).items():
                grad = grad + 1e-4 * model.weights[name]
                m, v = moments[name]
                m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
                moments[name] = m, v
                model.weights[name] = model.weights[name] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 3, which: int = 1, limit: int = LIMIT, text_col: str = "text") -> AttentionModel:
    """Fit on the labelled sample. Only descriptions of its passages come to the driver: at
    most ``limit * LONGEST`` of FEATURES numbers, a few MB for ordinary texts."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in text_pieces(batch, "text"):
                x, first = passages(data, bounds)
                yield pa.record_batch({
                    "label": rows.column("label"),
                    "bag": pa.array([x[a:b].tobytes() if b - a <= LONGEST else None for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())})

    sample = training_sample(docs, labels, label_col, folds, which, limit, text_col)
    got = sample.mapInArrow(describe, "label int, bag binary").filter("bag is not null").toPandas()
    got = got.sort_values(["bag", "label"])  # the order of arrival must not matter
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in got["bag"]]
    return fit(bags, got["label"].to_numpy(np.float64))


def score(docs: DataFrame, model: AttentionModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in ``name``."""
    out = docs.drop(name).withColumn(name, F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in text_pieces(batch, text_col):
                x, first = passages(data, bounds)
                place = rows.schema.get_field_index(name)
                yield rows.set_column(place, name, pa.array(model.score(x, first)))

    return out.mapInArrow(run, out.schema)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, text_col: str = "text", **options) -> DataFrame:
    """``docs`` scored at ``least`` or more; columns unchanged."""
    name = free_name(docs, "quality_score")
    model = learn(docs, labels, text_col=text_col, **options)
    return score(docs, model, text_col, name).filter(F.col(name) >= least).select(docs.columns)
