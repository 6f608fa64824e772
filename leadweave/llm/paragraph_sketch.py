"""Document fingerprints as invertible Bloom lookup sketches of paragraphs.

A text is a multiset of paragraphs: its lines, cut after sentence ends (``.``, ``!`` or ``?``
before a blank), and where no sentence ends for ``LONG`` words, after words whose hash says so,
so that an edit soon moves no cut any more, or else after ``LONG`` words; words of over
``LONG_WORD`` bytes every ``LONG_WORD`` bytes. Blank paragraphs don't count. The n-th occurrence of a
paragraph is a key of its own: a 64-bit hash of the paragraph mixed with n.

A sketch has ``cells`` cells in three equal tables; a key is added to one cell of each: the cell
counts it and XORs it and a check of it. Sketches subtract cell by cell, and what both versions
hold cancels out. A cell left with one key (count 1 or -1, check agreeing) gives it up, which
takes it from its other cells too; when all cells are empty, every differing digest is known
with its side. If peeling stops earlier the sketch was too small: both versions are sketched
anew, four times larger, until it does not. The fingerprint is the smallest sketch in hex.

Sketches of a whole piece of a batch are built, subtracted and peeled at once; only pairs that
fail go on to larger ones. A text is held whole, and what is held beside it follows its own
number of paragraphs.

Defined results: NULL texts are empty texts; two texts without paragraphs are alike (1.0).
Order of paragraphs doesn't matter, spaces at their ends neither. Repeated rows are judged each.
Other columns pass through in one struct, whatever their names; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadweave.llm.common import WHITESPACE, mixed, run_starts, span_hashes, text_pieces, word_spans

CELLS = 12
TABLES = 3
GROWTH = 4
LONG = 16
LONG_WORD = 128
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[list(b".!?")] = True
_SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


# --- paragraphs ----------------------------------------------------------------------------


def paragraph_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the paragraphs of a piece of texts, and the row of each."""
    starts, ends, first = word_spans(data, bounds, ~WHITESPACE)
    n = len(starts)
    if not n:
        return starts, ends, starts
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    feeds = np.append(0, np.cumsum(data == 10))
    begins = run_starts(row)
    begins[1:] |= feeds[starts[1:]] > feeds[ends[:-1]]
    begins[1:] |= _SENTENCE_END[data[ends[:-1] - 1]]
    sentence = np.cumsum(begins) - 1
    long = np.bincount(sentence)[sentence] >= LONG
    said = long & (span_hashes(data, starts, ends) % np.uint64(8) == 0)
    begins[1:] |= said[:-1]
    huge = ends - starts > LONG_WORD
    begins |= huge
    begins[1:] |= huge[:-1]
    at = np.flatnonzero(begins)
    place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    at = np.flatnonzero(begins | (long & (place % LONG == 0)))
    low, high, owner = starts[at], ends[np.append(at[1:], n) - 1], row[at]
    pieces = np.where(huge[at], -(-(high - low) // LONG_WORD), 1)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    low, high, owner, whole = (np.repeat(x, pieces) for x in (low, high, owner, pieces == 1))
    low = low + nth * LONG_WORD
    return low, np.where(whole, high, np.minimum(high, low + LONG_WORD)), owner


def paragraphs(text: bytes) -> list[bytes]:
    """The paragraphs of a UTF-8 text, in order."""
    low, high, _ = paragraph_spans(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    return [text[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]


def paragraph_keys(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all paragraphs of a piece and the row each belongs to. No two of a row are equal."""
    low, high, owner = paragraph_spans(data, bounds)
    digests = span_hashes(data, low, high)
    order = np.lexsort((digests, owner))
    digests, owner = digests[order], owner[order]
    first = run_starts(owner, digests)
    place = np.arange(len(owner))
    occurrence = place - np.maximum.accumulate(np.where(first, place, 0)) if len(owner) else place
    return mixed(digests + occurrence.astype(np.uint64) * _SALTS[0]), owner


# --- sketches ------------------------------------------------------------------------------


def _spots(keys: np.ndarray, owner: np.ndarray, cells: int) -> np.ndarray:
    """(TABLES, keys): the cell of each key in each table, counted over all rows."""
    each = cells // TABLES
    return np.stack([
        owner * cells + t * each + ((mixed(keys ^ _SALTS[t]) >> np.uint64(33)) % np.uint64(each)).astype(np.int64) for t in range(TABLES)])


def _check(keys: np.ndarray) -> np.ndarray:
    return mixed(keys + _SALTS[3]) >> np.uint64(32)


def sketches(keys: np.ndarray, owner: np.ndarray, rows: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, XORed keys and XORed checks, each (rows * cells)."""
    spots = _spots(keys, owner, cells).ravel()
    count = np.bincount(spots, minlength=rows * cells)
    held, check = np.zeros(rows * cells, np.uint64), np.zeros(rows * cells, np.uint64)
    np.bitwise_xor.at(held, spots, np.tile(keys, TABLES))
    np.bitwise_xor.at(check, spots, np.tile(_check(keys), TABLES))
    return count, held, check


def hex_sketches(keys: np.ndarray, owner: np.ndarray, rows: int, cells: int) -> list[str]:
    """32 hex digits a cell: count, keys, checks."""
    count, held, check = sketches(keys, owner, rows, cells)
    packed = np.zeros((rows, cells), np.dtype([("n", ">u4"), ("key", ">u8"), ("check", ">u4")]))
    for name, values in (("n", count), ("key", held), ("check", check)):
        packed[name] = values.reshape(rows, cells)
    return [row.tobytes().hex() for row in packed]


def peel(count: np.ndarray, held: np.ndarray, check: np.ndarray, rows: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Peel subtracted sketches in place: (keys, their rows, their side 1 or -1, rows emptied)."""
    keys, owners, sides = [], [], []
    for _ in range(TABLES * cells + 1):  # a key leaves per step, or a false one was taken
        pure = np.flatnonzero((np.abs(count) == 1) & (_check(held) == check))
        if not len(pure):
            break
        key, owner, side = held[pure], pure // cells, count[pure]
        order = np.lexsort((key, owner))
        order = order[run_starts(owner[order], key[order])]
        key, owner, side = key[order], owner[order], side[order]
        spots = _spots(key, owner, cells).ravel()
        np.subtract.at(count, spots, np.tile(side, TABLES))
        np.bitwise_xor.at(held, spots, np.tile(key, TABLES))
        np.bitwise_xor.at(check, spots, np.tile(_check(key), TABLES))
        keys.append(key)
        owners.append(owner)
        sides.append(side)
    left = (count != 0) | (held != 0) | (check != 0)
    done = ~left.reshape(rows, cells).any(axis=1)
    join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    return join(keys, np.uint64), join(owners, np.int64), join(sides, np.int64), done


def differing(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], rows: int, cells: int = CELLS) -> tuple[np.ndarray, ...]:
    """Differing digests of row pairs by subtraction and peeling: (keys, rows, side 1 for left
    and -1 for right, cells that sufficed for each row). ``left`` and ``right``: keys and their
    rows."""
    sizes, found = np.zeros(rows, np.int64), []
    open_rows = np.arange(rows)
    while len(open_rows):
        number = np.full(rows, -1)
        number[open_rows] = np.arange(len(open_rows))
        parts = []
        for keys, owner in (left, right):
            mine = number[owner] >= 0
            parts.append(sketches(keys[mine], number[owner[mine]], len(open_rows), cells))
        (n1, h1, c1), (n2, h2, c2) = parts
        keys, owner, side, done = peel(n1 - n2, h1 ^ h2, c1 ^ c2, len(open_rows), cells)
        good = done[owner]
        found.append((keys[good], open_rows[owner[good]], side[good]))
        sizes[open_rows[done]] = cells
        open_rows, cells = open_rows[~done], cells * GROWTH
    keys, owner, side = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return keys, owner, side, sizes


# --- on tables -----------------------------------------------------------------------------

VERDICT = "struct<only_left: array<bigint>, only_right: array<bigint>, n_left: bigint, n_right: bigint, cells: bigint, likeness: double>"


def _lists(keys: np.ndarray, owner: np.ndarray, rows: int) -> pa.Array:
    order = np.lexsort((keys, owner))
    bounds = np.searchsorted(owner[order], np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys[order].view(np.int64)))


def _verdicts(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], rows: int, cells: int) -> pa.StructArray:
    keys, owner, side, sizes = differing(left, right, rows, cells)
    n_left, n_right, off = (np.bincount(x, minlength=rows) for x in (left[1], right[1], owner))
    total = n_left + n_right
    likeness = np.where(total > 0, 1.0 - off / np.maximum(total, 1), 1.0)
    a, b = side > 0, side < 0
    return pa.StructArray.from_arrays(
        [_lists(keys[a], owner[a], rows), _lists(keys[b], owner[b], rows), pa.array(n_left), pa.array(n_right), pa.array(sizes), pa.array(likeness)],
        names=["only_left", "only_right", "n_left", "n_right", "cells", "likeness"])


def _pieces(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]]:
    """Whole rows in pieces of about ``PIECE_BYTES`` of the first column's text, each with the
    bytes and bounds of its texts by column."""
    for rows, _, _ in text_pieces(batch, columns[0]):
        held = []
        for c in columns:
            alike = [(data, bounds) for _, data, bounds in text_pieces(rows, c)]
            start = np.cumsum([0] + [len(data) for data, _ in alike])
            held.append((np.concatenate([data for data, _ in alike]), np.concatenate(
                [bounds[:-1] + at for (_, bounds), at in zip(alike, start[:-1], strict=True)] + [start[-1:]])))
        yield rows, held


def compare(versions: DataFrame, base: str, others: list[str], cells: int = CELLS) -> DataFrame:
    """given (struct of the other columns) and one struct per text column: the fingerprint; for
    each of ``others`` also what its sketch less that of ``base`` gives: digests only in base
    (only_left) and only there (only_right), paragraph counts, the cells it took, likeness
    (paragraphs in common, of the mean number of both)."""
    if cells % TABLES:
        raise ValueError(f"cells must be a multiple of {TABLES}")
    columns = [base, *others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in _pieces(batch, [f"text{k}" for k in range(len(columns))]):
                n = rows.num_rows
                keyed = [paragraph_keys(*t) for t in texts]
                prints = [pa.array(hex_sketches(*k, n, cells)) for k in keyed]
                verdicts = [_verdicts(keyed[0], k, n, cells) for k in keyed[1:]]
                yield pa.record_batch([rows.column("given"), *prints, *verdicts], names=["given", *names])

    names = [f"print{k}" for k in range(len(columns))] + [f"against{k}" for k in range(1, len(columns))]
    given = F.struct(*[F.col(f"`{c}`") for c in versions.columns if c not in columns])
    packed = versions.select(given.alias("given"), *[F.col(f"`{c}`").alias(f"text{k}") for k, c in enumerate(columns)])
    empty = packed.select("given", *[
        F.lit("").alias(c) if c.startswith("print") else F.lit(None).cast(VERDICT).alias(c) for c in names])
    return packed.mapInArrow(run, empty.schema)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """given (struct of the row's other columns), text, following (string): the text of the row
    next in descending order of the id; the last is followed by the first. Rows of one id follow each other by
    text, rows without an id come last, by a hash of their text.

    Rows are dealt once, with their texts, to ranges of the id. Where ranges meet is fixed
    beforehand by values alone (about 32 ids a range, picked by hash), and the first row of each
    range is sent to the one before it too, so that a window within a range sees what follows
    its last row. A task that is run again finds the same ranges."""
    spark = docs.sparkSession
    wanted = max(1, min(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), 4096))
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows, nameless = docs.agg(F.count(F.lit(1)), F.count(F.when(ident.isNull(), 1))).first()
    every = max(1, rows // (32 * wanted))
    picked = sorted(r[0] for r in docs.select(ident.alias("id")).filter(
        F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(every)) == 0)).distinct().collect())
    splits = sorted({picked[len(picked) * k // wanted] for k in range(1, wanted)}) if picked else []
    edges = np.array(splits, dtype=None if splits and isinstance(splits[0], int) else object)

    @F.pandas_udf("int")
    def bucket_of(ids):
        import pandas as pd

        out = np.zeros(len(ids), np.int32)
        has = ids.notna().to_numpy()
        if len(edges) and has.any():
            out[has] = len(edges) - np.searchsorted(edges, ids[has].to_numpy(), side="right")
        return pd.Series(out)

    loose = F.when(ident.isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long")) if nameless else F.lit(0).cast("long")
    width = -(-(1 << 64) // wanted)
    last = F.lit(len(splits) + 1) + F.floor((F.lit(2.0**63) - F.col("hash")) / F.lit(float(width))).cast("int")
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    dealt = docs.select(others.alias("given"), ident.alias("id"), loose.alias("hash"), text.alias("text"))
    place = bucket_of("id") if not nameless else F.when(F.col("id").isNull(), last).otherwise(bucket_of("id"))
    dealt = dealt.withColumn("bucket", place)
    firsts = sorted(dealt.groupBy("bucket").agg(F.max(F.struct(F.col("id").isNotNull().alias("has"), "id", "hash")).alias("top")).collect())
    if not firsts:
        return dealt.select("given", "text", F.col("text").alias("following"))
    schema = dealt.select("bucket", F.col("bucket").alias("to"), "id", "hash").schema
    guests = spark.createDataFrame(
        [(b, firsts[k - 1][0], top["id"], top["hash"]) for k, (b, top) in enumerate(firsts)], schema
    ).select(F.col("bucket").alias("of"), "to", F.col("id").alias("first_id"), F.col("hash").alias("first_hash"))
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))
    there = F.struct(F.col("to").alias("bucket"), F.lit(1).alias("guest"))
    is_first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash"))
    # at most one row per range is broadcast
    sent = dealt.join(F.broadcast(guests), F.col("bucket") == F.col("of")).select(
        "given", "id", "hash", "text", F.inline(F.when(is_first, F.array(here, there)).otherwise(F.array(here))))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("id").desc_nulls_last(), F.col("hash").desc(), F.col("text").desc_nulls_last())
    return sent.withColumn("following", F.lead("text").over(order)).filter("guest = 0").select("given", "text", "following")


def edited(text, following):
    """A text whose last half (rounded down) of code points is replaced by the first as many,
    or all, of the following text."""
    text, following = F.coalesce(text, F.lit("")), F.coalesce(following, F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))
