"""What several operators share: written tables, Arrow text as bytes, words and word hashes.

Texts are handled as UTF-8 bytes with numpy. A document is never cut: pieces of a batch are
whole rows, so that what is held at a time follows the longest text, not the table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.session import ensure_checkpoint_dir

PIECE_BYTES = 1 << 20
WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower-cased; a byte of a longer character counts.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[65:91] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True


def packed(df: DataFrame) -> Column:
    """The whole row as one struct, so that no column of its own can clash with a working one."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpacked(columns: list[str], replaced: dict[str, Column] | None = None, given: str = "given") -> list[Column]:
    """The columns of a packed row under their names and in their order, some of them replaced."""
    replaced = replaced or {}
    return [replaced.get(c, F.col(given).getField(c)).alias(c) for c in columns]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores, so that it is none of the columns' (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: lineage ends here, and a
    join that follows plans its own exchange over the table, which adaptive execution can split."""
    spark: SparkSession = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_pieces(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Whole rows of a batch in pieces of about ``PIECE_BYTES`` of text, each with the bytes of
    its texts and the n + 1 offsets of the rows in them. NULL is an empty text."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    _, where, held = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, "right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, bounds: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the maximal runs of ``member`` bytes, none across two rows, and
    for every row the number of its first word (n + 1 values)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = member[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans, equal wherever a span stands: one running polynomial sum over
    the bytes, differenced at the spans. ``lower`` reads A-Z as a-z."""
    power, inverse = _powers(len(data) + 1)
    values = _BYTE_VALUES[LOWER] if lower else _BYTE_VALUES
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * power[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * inverse[starts])


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before in any column; the first row is True."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds; an empty range sums to 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
