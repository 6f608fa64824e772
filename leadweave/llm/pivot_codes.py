"""Product codes of vectors, with nearest entries found over LAESA pivots.

A vector is kept if it has ``dims`` components, none NULL or non-finite; ``dims`` is the length
of the first kept vector (least id, NULL ids last) that ``parts`` divides. Components become
integers floor(scale * x), vectors are cut into equal consecutive parts, and each part position
has a codebook that starts as that part of the first ``entries`` vectors by id. A round assigns
every part to the nearest entry (squared Euclidean distance, ties to the lower index) and moves
each entry to the componentwise floor of the mean of its parts; unused entries stay.

Pivots: of the first codebook, entries far from each other are fixed as pivots. The distances of
every part to them are computed once and written beside the parts. In a round only the entries'
distances to the pivots are new; by the triangle inequality, the largest difference of two
pivot distances is a lower bound of the distance of part and entry. The entries of a part are
taken in order of this bound, in growing waves, and those whose bound exceeds the best exact
distance so far are never evaluated. Bounds are floats lowered by their rounding error, all
distances that decide are exact integers, so the outcome is that of trying every entry.

A round is one pass over the written parts; a task returns the sums and counts of its parts by
entry, so that what is shuffled follows the codebook, not the vectors. Codebooks (``entries``
times ``dims`` integers) are the only thing that reaches the driver or is sent to tasks.

Defined results: fewer vectors than entries give a smaller codebook; repeated ids stand for
themselves, in order of their components; an empty table gives no rows. Other columns pass
through in one struct, whatever their names. Components too large for 64-bit arithmetic
(about 8,000 at 16 components a part) are an error, not a wrong code."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE, PIVOTS = 4, 256, 4, 1024, 16
BLOCK = 512
#: float32 bounds are off by a few units in the last place of either distance.
_ROUNDING = np.float32(2.0**-21)


@dataclass
class Compressed:
    """``rows``: given (struct of the kept row), codes (array of int), error (long), evaluated
    (long, exact distances of the last pass); ``codebooks``: (parts, entries, width)."""

    rows: DataFrame
    codebooks: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def fixed_pivots(codebook: np.ndarray, count: int) -> np.ndarray:
    """Rows of a codebook, each the one with the largest sum of distances to those before."""
    reach, chosen = np.zeros(len(codebook)), [0]
    while len(chosen) < min(count, len(codebook)):
        reach += np.sqrt(((codebook - codebook[chosen[-1]]) ** 2).sum(axis=1))
        reach[chosen] = -1.0
        chosen.append(int(np.argmax(reach)))
    return codebook[chosen]


def pivot_distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows[:, None, :] - pivots[None]) ** 2).sum(axis=2)).astype(np.float32)


def nearest(parts: np.ndarray, far: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of the nearest entry of each part, and how many exact
    distances it took. ``far``: the parts' distances to the pivots."""
    entry_far = pivot_distances(entries, pivots)
    bound = np.zeros((len(parts), len(entries)), np.float32)
    apart = np.empty_like(bound)
    for k in range(len(pivots)):
        np.subtract(far[:, k, None], entry_far[None, :, k], out=apart)
        np.maximum(bound, np.abs(apart, out=apart), out=bound)
    bound -= (far.max(initial=0) + entry_far.max(initial=0)) * _ROUNDING
    order = np.argsort(bound, axis=1)
    bound = np.take_along_axis(bound, order, axis=1).astype(np.float64)
    np.maximum(bound, 0.0, out=bound)
    bound *= bound * (1 - 1e-12)
    wide, wide_entries = parts.astype(np.float64), entries.astype(np.float64)  # whole numbers below 2**53
    most = np.iinfo(np.int64).max
    best = np.full(len(parts), most)  # distance * entries + index, so that ties go to the lower one
    evaluated, done, wave = 0, 0, 1
    live = np.arange(len(parts))
    while done < len(entries) and len(live):
        reach = best[live] // len(entries)
        row, place = np.nonzero(bound[live, done : done + wave] <= reach[:, None])
        if len(row):
            owner, entry = live[row], order[live[row], done + place]
            gap = wide[owner] - wide_entries[entry]
            keyed = np.einsum("ij,ij->i", gap, gap).astype(np.int64) * len(entries) + entry
            evaluated += len(row)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            best[owner[first]] = np.minimum(best[owner[first]], np.minimum.reduceat(keyed, first))
        done, wave = done + wave, wave * 3
        if done < len(entries):
            live = live[bound[live, done] <= best[live] // len(entries)]
    return best % len(entries), best // len(entries), evaluated


def _components(batch: pa.RecordBatch, column: str, width: int, kind: type) -> np.ndarray:
    """A column of lists of ``width`` values as (rows, width)."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def _assign(batch: pa.RecordBatch, codebooks: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Integer parts (rows, parts, width), codes and squared distances (rows, parts), evaluations."""
    n_parts, _, width = codebooks.shape
    parts = _components(batch, "parts", n_parts * width, np.int64).reshape(-1, n_parts, width)
    far = _components(batch, "far", pivots.shape[0] * pivots.shape[1], np.float32).reshape(-1, *pivots.shape[:2])
    codes, errors, total = np.zeros(parts.shape[:2], np.int64), np.zeros(parts.shape[:2], np.int64), 0
    for p in range(n_parts):
        codes[:, p], errors[:, p], n = nearest(parts[:, p], far[:, p], codebooks[p], pivots[p])
        total += n
    return parts, codes, errors, total


def _moved(table: DataFrame, codebooks: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    n_parts, n_entries, width = codebooks.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_parts * n_entries, width + 1), np.int64)
        for batch in _blocks(batches):
            parts, codes, _, _ = _assign(batch, codebooks, pivots)
            at = codes + np.arange(n_parts) * n_entries
            np.add.at(total, at.ravel(), np.concatenate([parts, np.ones((*at.shape, 1), np.int64)], axis=2).reshape(-1, width + 1))
        used = np.flatnonzero(total[:, -1])
        yield pa.record_batch({"entry": pa.array(used.astype(np.int32)), **{f"s{k}": pa.array(total[used, k]) for k in range(width + 1)}})

    columns = [f"s{k}" for k in range(width + 1)]
    found = table.select("parts", "far").mapInArrow(sums, "entry int, " + ", ".join(f"{c} long" for c in columns))
    moved = codebooks.reshape(-1, width).copy()
    for row in found.groupBy("entry").agg(*[F.sum(c).alias(c) for c in columns]).collect():
        moved[row[0]] = np.array(row[1:-1], np.int64) // row[-1]
    return moved.reshape(codebooks.shape)


def kept_vectors(vectors: DataFrame, vector_col: str, id_col: str, parts: int, scale: int) -> tuple[DataFrame, int]:
    """given, id, ints (array of long) of the rows that count, and ``dims`` (0: there are none)."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    given = F.struct(*[F.col(f"`{c}`") for c in vectors.columns if c != vector_col])
    whole = vectors.filter(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0)).filter(finite).select(
        given.alias("given"), F.col(id_col).alias("id"),
        F.transform(v, lambda x: F.when(F.abs(x) < 2.0**40, F.floor(x * scale)).otherwise(F.lit(1 << 50))).alias("ints"))
    first = whole.orderBy(F.col("id").asc_nulls_last(), "ints").select(F.size("ints")).first()
    dims = first[0] if first else 0
    return whole.filter(F.size("ints") == dims), dims


def compress(
    vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, scale: int = SCALE, pivots: int = PIVOTS,
) -> Compressed:
    kept, dims = kept_vectors(vectors, vector_col, id_col, parts, scale)
    empty = kept.select("given", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("evaluated"))
    if not dims:
        return Compressed(empty.limit(0), np.zeros((parts, 0, 0), np.int64))
    width = dims // parts
    start = np.array([r[0] for r in kept.orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()], np.int64)
    codebooks = np.ascontiguousarray(start.reshape(-1, parts, width).transpose(1, 0, 2))
    fixed = np.stack([fixed_pivots(book, pivots) for book in codebooks])
    widest = int(np.sqrt(min((1 << 62) / codebooks.shape[1], 1 << 53) / (4 * width)))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            ints = _components(batch, "ints", dims, np.int64)
            if np.abs(ints).max(initial=0) > widest:
                raise ValueError(f"components beyond {widest / scale:.0f} don't fit the integer distances")
            cut = ints.reshape(-1, parts, width)
            far = np.stack([pivot_distances(cut[:, p], fixed[p]) for p in range(parts)], axis=1)
            rows = [pa.array(list(x.reshape(len(ints), -1).astype(kind))) for x, kind in ((ints, np.int32), (far, np.float32))]
            yield pa.record_batch([batch.column("given"), *rows], names=["given", "parts", "far"])

    shape = kept.select("given", F.array().cast("array<int>").alias("parts"), F.array().cast("array<float>").alias("far")).schema
    table = written(kept.select("given", "ints").mapInArrow(measured, shape), "vector-parts")
    for _ in range(rounds):
        codebooks = _moved(table, codebooks, fixed)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            _, codes, errors, total = _assign(batch, codebooks, fixed)
            share = np.full(len(codes), total // max(len(codes), 1))
            share[: total - int(share.sum())] += 1
            yield pa.record_batch(
                [batch.column("given"), pa.array(list(codes.astype(np.int32))), pa.array(errors.sum(axis=1)), pa.array(share)],
                names=["given", "codes", "error", "evaluated"])

    return Compressed(table.mapInArrow(coded, empty.schema), codebooks)


def code_of(codes: Column) -> Column:
    """Codes as two lowercase hex digits each."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")


def with_error_by(found: Compressed, column: str, id_col: str = "vec_id") -> DataFrame:
    """``found.rows`` with label_error: errors summed over rows of an equal ``column`` of the
    given row, NULLs together. One sum per value is joined back; rows of a hot value are dealt
    to sixteen partitions by a hash of their id."""
    rows = written(found.rows.withColumn("label", F.col("given")[column]), "coded")
    sums = written(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    salted = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    mine = rows.withColumn("mine", F.pmod(F.xxhash64(F.col("given")[id_col]), F.lit(16)).cast("int"))
    return mine.join(salted, F.col("label").eqNullSafe(F.col("of")) & (F.col("mine") == F.col("salt"))).drop("of", "salt", "mine", "label")
