import hashlib
import math
import random

import numpy as np

from leadweave.llm import pivot_codes as P
from pyspark.sql import functions as F


def plain_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """{position of the row: (code, error)}, codebooks; every entry is tried."""
    kept = sorted(((i, v, n) for n, (i, v) in enumerate(rows) if v is not None and v and all(x is not None and math.isfinite(x) for x in v)),
                  key=lambda r: (r[0] is None, r[0] or 0, [math.floor(scale * x) for x in r[1]]))
    ints = [[math.floor(scale * x) for x in v] for _, v, _ in kept]
    w = len(ints[0]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for v in ints[:entries]] for p in range(parts)]

    def assign():
        out = []
        for v in ints:
            row = []
            for p in range(parts):
                row.append(min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p])))
            out.append(row)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(v, p) for v, row in zip(ints, found, strict=True) if row[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = {n: ("".join(f"{k:02x}" for _, k in row), sum(d for d, _ in row)) for (_, _, n), row in zip(kept, assign(), strict=True)}
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def vectors(seed, n, dims=8):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 0.2) for _ in range(dims)] for _ in range(5)]
    out = [(k, [float(np.float32(c + rng.gauss(0, 0.05))) for c in rng.choice(centers)]) for k in range(n)]
    out += [(n + k, out[3][1]) for k in range(n // 3)]  # a third of all rows is one vector
    return out + [(2 * n, None), (2 * n + 1, [0.1] * (dims - 1) + [None]), (2 * n + 2, [math.nan] * dims), (2 * n + 3, [math.inf] * dims), (2 * n + 4, [])]


def test_codes_against_all_entries(spark):
    rows = vectors(1, 90)
    random.Random(2).shuffle(rows)
    labels = {i: (None if i % 7 == 0 else i % 3) for i, _ in rows}
    df = spark.createDataFrame([(i, v, labels[i], "own") for i, v in rows], "vec_id long, embedding array<float>, label int, codes string").repartition(5)
    want, digest = plain_codes(rows, entries=16)
    found = P.compress(df, entries=16, pivots=3)
    got = {r[0]: r[1:] for r in P.with_error_by(found, "label").select(
        "given.vec_id", P.code_of(F.col("codes")).alias("code"), "error", "label_error", "given.codes").collect()}
    assert found.sha256 == digest
    by_id = {rows[n][0]: x for n, x in want.items()}
    assert {i: x[:2] for i, x in got.items()} == by_id
    for i, (_, _, of_label, own) in got.items():
        assert own == "own" and of_label == sum(e for j, (_, e) in by_id.items() if labels[j] == labels[i])


def test_pruning_loses_nothing():
    rng = np.random.default_rng(5)
    centers = rng.integers(-900, 900, (12, 6))
    parts = centers[rng.integers(0, 12, 500)] + rng.integers(-20, 20, (500, 6))
    entries = np.concatenate([parts[:60], parts[:20], parts[:1]])  # ties between equal entries
    pivots = P.fixed_pivots(entries, 6)
    index, distance, evaluated = P.nearest(parts, P.pivot_distances(parts, pivots), entries, pivots)
    every = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (distance == every.min(axis=1)).all() and (index == every.argmin(axis=1)).all()
    assert evaluated < every.size / 3


def test_odd_vectors(spark):
    schema = "vec_id long, embedding array<double>, label string"
    rows = [(1, [0.5, 0.25, 0.0, 1.0], "a"), (1, [0.5, 0.25, 0.0, 1.0], "a"), (1, [0.0, 0.0, 0.0, 0.0], None), (None, [1.0, 1.0, 1.0, 1.0], None), (2, [1.0] * 8, "b")]
    df = spark.createDataFrame(rows, schema)
    found = P.compress(df, entries=2)
    out = sorted(map(tuple, P.with_error_by(found, "label").select("given.vec_id", "error", "label_error").collect()), key=str)
    want, digest = plain_codes([r[:2] for r in rows[:4]], entries=2)
    assert found.sha256 == digest and sorted(x[1] for x in out) == sorted(e for _, e in want.values()) and len(out) == 4
    for empty in (df.limit(0), df.filter("embedding is null")):
        none = P.compress(empty)
        assert P.with_error_by(none, "label").count() == 0 and none.codebooks.size == 0
    huge = P.compress(df, entries=1)
    assert huge.rows.count() == 4
    try:
        P.compress(spark.createDataFrame([(1, [1e30] * 4, "a")], schema), rounds=0).rows.collect()
        raise AssertionError("too large components must not pass")
    except Exception as problem:
        assert "don't fit" in str(problem)
