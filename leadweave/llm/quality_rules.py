"""Quality rules with cross-document line frequency.

Base statistics of every whole text are taken in one pass; with them a row carries the hash and
the word count of each of its lines that has a word. A line is normalised to its words, A-Z
lower-cased. That digest, without texts, is written once and gives rows a number; what follows
are aggregates over it: distinct documents per host and line, lines above the limits (more than
``max_docs`` documents and more than ``max_share`` of the host's), the words each document
loses with them. A document that keeps less than ``least_kept`` of its words, or fewer than
``least_words``, is depleted. The line table is joined to the frequent lines by host and hash;
both are planned by size, and a hot line is split as any skewed key.

Base rule: fewer than ``least_words`` words, or over a fifth of the words in five-word windows
that the text holds twice or more.

Defined results: NULL and empty texts have no words and fail the base rule. NULL host is a host
of its own. Repeated rows are documents each. Other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.llm.common import WHITESPACE, _powers, mixed, row_sums, run_starts, span_hashes, text_pieces, word_spans, written

MAX_DOCS = 20
MAX_SHARE = 0.1
LEAST_KEPT = 0.5
LEAST_WORDS = 10
_WINDOW = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WEIGHTS = np.random.default_rng(11).integers(0, 1 << 62, _WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of stretches of numbers, equal wherever a stretch stands."""
    power, inverse = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mixed((total[ends] - total[starts]) * inverse[starts])


def _earlier_equal(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (row, key), starts of equal runs in it, lengths of the runs."""
    order = np.lexsort((keys, row))
    head = np.flatnonzero(run_starts(keys[order], row[order]))
    return order, head, np.diff(np.append(head, len(order)))


def line_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the lines of every row, and each line's row."""
    feeds = np.flatnonzero(data == 10)
    of = np.searchsorted(bounds, feeds, "right") - 1
    n = np.bincount(of, minlength=len(bounds) - 1) + 1
    first = np.append(0, np.cumsum(n))
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    starts[first[:-1]], ends[first[1:] - 1] = bounds[:-1], bounds[1:]
    place = np.arange(len(feeds)) + of
    starts[place + 1], ends[place] = feeds + 1, feeds
    return starts, ends, np.repeat(np.arange(len(n)), n)


def statistics(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Base statistics by row, and line_hash, line_words, line_first for lines with a word."""
    starts, ends, first = word_spans(data, bounds, ~WHITESPACE)
    rows = len(bounds) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    out = {
        "n_words": np.diff(first),
        "word_chars": row_sums(~WHITESPACE[data] & ((data & 0xC0) != 0x80), bounds),
        "n_symbols": row_sums(_SYMBOL[data], bounds)}
    exact = span_hashes(data, starts, ends)
    repeated = np.zeros(len(exact) + 1, np.int64)
    at = np.flatnonzero(np.arange(len(exact)) + _WINDOW <= first[1:][row]) if len(exact) else np.zeros(0, np.int64)
    window = np.zeros(len(at), np.uint64)
    for k in range(_WINDOW):
        window += exact[at + k] * _WEIGHTS[k]
    order, head, n = _earlier_equal(mixed(window), row[at])
    again = at[order[np.repeat(n > 1, n)]]
    np.add.at(repeated, again, 1)
    np.add.at(repeated, again + _WINDOW, -1)
    out["n_repeat_words"] = row_sums(np.cumsum(repeated)[:-1] > 0, first)
    low, high, line_row = line_spans(data, bounds)
    words = np.stack([np.searchsorted(starts, low), np.searchsorted(starts, high)])
    full = words[1] > words[0]
    low, high, line_row, words = low[full], high[full], line_row[full], words[:, full]
    order, head, n = _earlier_equal(span_hashes(data, low, high), line_row)
    out["n_dup_lines"] = np.bincount(line_row[order[head]], weights=n - 1, minlength=rows).astype(np.int64)
    folded = span_hashes(data, starts, ends, lower=True)
    out |= {"line_hash": sequence_hashes(folded, words[0], words[1]).view(np.int64), "line_words": words[1] - words[0],
            "line_first": np.searchsorted(line_row, np.arange(rows + 1))}
    return out


_NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def digest(docs: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, _host, the base statistics, and _lines: hash and words of every line."""
    given = docs.select("doc_id", F.col(host_col).cast("string").alias("_host"), F.col(text_col).alias("_text"))
    lines = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in text_pieces(batch, "_text"):
                got = statistics(data, bounds)
                pairs = pa.StructArray.from_arrays([pa.array(got["line_hash"]), pa.array(got["line_words"])], ["line", "words"])
                listed = pa.ListArray.from_arrays(pa.array(got["line_first"], pa.int32()), pairs)
                yield pa.record_batch(
                    [rows.column("doc_id"), rows.column("_host"), *(pa.array(got[n], pa.int64()) for n in _NUMBERS), listed.cast(lines)],
                    ["doc_id", "_host", *_NUMBERS, "_lines"])

    kind = ", ".join(f"{n} bigint" for n in _NUMBERS)
    id_type = dict(given.dtypes)["doc_id"]
    return given.mapInArrow(run, f"doc_id {id_type}, _host string, {kind}, _lines array<struct<line: bigint, words: bigint>>")


def judge(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE,
    least_kept: float = LEAST_KEPT, least_words: int = LEAST_WORDS,
) -> DataFrame:
    """doc_id, the base statistics, base_failed, lost_words (in lines above the limits), kept."""
    rows = written(digest(docs, host_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "line-digest")
    lines = rows.select("_row", "_host", F.inline("_lines"))
    totals = written(rows.groupBy("_host").agg(F.count(F.lit(1)).alias("_docs")), "host-docs").withColumnRenamed("_host", "_of")
    once = rows.select("_host", F.explode(F.array_distinct(F.col("_lines.line"))).alias("line"))
    common = once.groupBy("_host", "line").agg(F.count(F.lit(1)).alias("_in")).filter(F.col("_in") > max_docs)
    frequent = written(
        common.join(totals, F.col("_host").eqNullSafe(F.col("_of")))
        .filter(F.col("_in") > F.lit(max_share) * F.col("_docs")).select(F.col("_host").alias("_of"), F.col("line").alias("_line")),
        "frequent-lines")
    lost = written(
        lines.join(frequent, F.col("_host").eqNullSafe(F.col("_of")) & (F.col("line") == F.col("_line")))
        .groupBy("_row").agg(F.sum("words").alias("lost_words")), "lost-words")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("lost_words")
    return rows.drop("_lines").join(lost, "_row", "left").withColumn("lost_words", F.coalesce("lost_words", F.lit(0).cast("long"))).select(
        "doc_id", *_NUMBERS, failed.alias("base_failed"), "lost_words",
        (~failed & (left >= F.lit(least_kept) * F.col("n_words")) & (left >= least_words)).alias("kept"))
