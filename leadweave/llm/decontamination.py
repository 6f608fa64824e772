"""Benchmark decontamination: an FM-index per training shard, searched for benchmark phrases.

Words are maximal runs of letters, digits and non-ASCII characters, A-Z lower-cased. A phrase is
``window`` consecutive words of an item; an item of fewer words is one phrase, one of none has
none. A task takes its documents in shards of bounded size, numbers their words by the
benchmark's vocabulary and builds one FM-index per shard. A stretch of known words that is
shorter than every phrase holds none and is left out of the index; the rest is kept whole. All
phrases are searched backward through the wavelet ranks, their occurrences located by sampled
suffix positions and merged into removal spans. No shuffle: a document's verdict is known where
it was read.

The benchmark is the query set. It reaches the tasks in blocks of at most ``block_bytes`` of
text; further blocks are further passes over the same rows, whose spans are merged.

Defined results: NULL or empty text has no words and no spans. Items without words have no
phrase. An item with NULL id marks words but is not listed. Repeated items are listed once,
repeated documents are judged each. A column with the name of the result is replaced, other
columns pass through. An empty benchmark flags nothing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadweave.llm.common import ALPHANUMERIC, free_name, run_starts, span_hashes, text_pieces, word_spans
from leadweave.llm.fm_index import FMIndex

WINDOW = 13
SHARD_WORDS = 1 << 20
SHARD_BYTES = 32 << 20

SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("first_word", "end_word", "start", "end")])
OVERLAP = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(SPAN)),
    T.StructField("items", T.ArrayType(T.StringType())),
])
_SPAN = pa.struct([(n, pa.int32()) for n in ("first_word", "end_word", "start", "end")])
_OVERLAP = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])


@dataclass
class Phrases:
    """One block of the benchmark: word hashes in order (word k has number k + 1), distinct
    phrases by length, and the items of each phrase as pairs."""

    vocabulary: np.ndarray
    by_length: list[np.ndarray]
    owners: list[tuple[np.ndarray, np.ndarray]]  # phrase bounds into item numbers
    items: list[str | None]

    @property
    def shortest(self) -> int:
        return min(p.shape[1] for p in self.by_length)


def phrases_of(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Phrases | None:
    """(item id, text) pairs as phrases; None if no item has a word."""
    batch = pa.record_batch({"text": pa.array([t for _, t in items], pa.string())})
    words: list[np.ndarray] = []
    for _, data, bounds in text_pieces(batch, "text"):
        starts, ends, first = word_spans(data, bounds, ALPHANUMERIC)
        hashes = span_hashes(data, starts, ends, lower=True)
        words += [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    if not any(len(w) for w in words):
        return None
    vocabulary = np.unique(np.concatenate(words))
    by_length, owners = [], []
    for length in sorted({min(len(w), window) for w in words} - {0}):
        rows, whose = [], []
        for k, w in enumerate(words):
            if min(len(w), window) == length:
                rows.append(np.lib.stride_tricks.sliding_window_view(np.searchsorted(vocabulary, w) + 1, length))
                whose.append(np.full(len(rows[-1]), k))
        distinct, phrase = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([phrase.ravel(), np.concatenate(whose)], 1), axis=0)
        by_length.append(distinct)
        owners.append((np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1]))
    return Phrases(vocabulary, by_length, owners, [i for i, _ in items])


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 8 << 20) -> Iterator[Phrases]:
    """The benchmark (item_id, text) in blocks of whole items."""
    block: list[tuple[str | None, str | None]] = []
    held = 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text")).toLocalIterator()
    for item, text in rows:
        if block and held + len(text or "") > block_bytes:
            if found := phrases_of(block, window):
                yield found
            block, held = [], 0
        block.append((item, text))
        held += len(text or "")
    if block and (found := phrases_of(block, window)):
        yield found


class _Shard:
    """Rows of one task until an index over their words is due."""

    def __init__(self, phrases: Phrases, column: str):
        self.phrases, self.column = phrases, column
        self.clear()

    def clear(self) -> None:
        self.rows: list[pa.RecordBatch] = []
        self.n_words: list[np.ndarray] = []
        self.parts: list[np.ndarray] = []  # number, row, word, start, end of every indexed word
        self.n_rows = self.n_symbols = self.n_bytes = 0

    @property
    def full(self) -> bool:
        return self.n_symbols >= SHARD_WORDS or self.n_bytes >= SHARD_BYTES

    def add(self, rows: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray) -> None:
        starts, ends, first = word_spans(data, bounds, ALPHANUMERIC)
        hashes = span_hashes(data, starts, ends, lower=True)
        vocabulary = self.phrases.vocabulary
        place = np.searchsorted(vocabulary, hashes)
        place[place == len(vocabulary)] = 0
        known = vocabulary[place] == hashes
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
        at = np.flatnonzero(known)
        head = np.flatnonzero(run_starts(at - np.arange(len(at)), row[at]))
        length = np.diff(np.append(head, len(at)))
        stays = np.repeat(length >= self.phrases.shortest, length)
        new = np.zeros(len(at), bool)
        new[head] = True
        at, new = at[stays], new[stays]
        if len(at):
            characters = np.zeros(len(data) + 1, np.int64)  # of all rows of the piece
            np.cumsum((data & 0xC0) != 0x80, out=characters[1:])
            own = bounds[row[at]]
            part = np.zeros((5, len(at) + int(new.sum())), np.int64)
            into = np.arange(len(at)) + np.cumsum(new)  # one 0 before every stretch
            part[:, into] = [
                place[at] + 1, row[at] + self.n_rows, at - first[row[at]],
                characters[starts[at]] - characters[own], characters[ends[at]] - characters[own]]
            self.parts.append(part)
            self.n_symbols += part.shape[1]
        self.rows.append(rows)
        self.n_words.append(np.diff(first))
        self.n_rows += len(rows)
        self.n_bytes += len(data)

    def search(self) -> tuple[dict[int, list[tuple[int, int, int, int]]], dict[int, set[str]]]:
        """Spans and items by row of the shard."""
        spans: dict[int, list] = {}
        items: dict[int, set] = {}
        if not self.parts:
            return spans, items
        number, row, word, start, end = np.concatenate([*self.parts, np.zeros((5, 1), np.int64)], axis=1)
        index = FMIndex(number)
        edges = np.zeros(len(number) + 1, np.int64)
        for phrases, (bounds, owner) in zip(self.phrases.by_length, self.phrases.owners, strict=True):
            found, low, high = index.search(phrases)
            for k in range(0, len(found), 4096):  # occurrences of a few phrases at a time
                phrase, lo, hi = found[k : k + 4096], low[k : k + 4096], high[k : k + 4096]
                rows = np.repeat(lo - np.append(0, np.cumsum(hi - lo)[:-1]), hi - lo) + np.arange((hi - lo).sum())
                at = index.locate(rows)
                np.add.at(edges, at, 1)
                np.add.at(edges, at + phrases.shape[1], -1)
                pairs = np.unique(np.stack([row[at], np.repeat(phrase, hi - lo)], 1), axis=0)
                for r, p in pairs.tolist():
                    items.setdefault(r, set()).update(
                        i for k in owner[bounds[p] : bounds[p + 1]] if (i := self.phrases.items[k]) is not None)
        covered = np.flatnonzero(np.cumsum(edges)[:-1] > 0)
        head = np.flatnonzero(run_starts(covered - np.arange(len(covered)), row[covered], word[covered] - np.arange(len(covered))))
        for a, b in zip(head, np.append(head, len(covered))[1:], strict=True):
            i, j = covered[a], covered[b - 1]
            spans.setdefault(int(row[i]), []).append((int(word[i]), int(word[j]) + 1, int(start[i]), int(end[j])))
        return spans, items

    def results(self, name: str) -> Iterator[pa.RecordBatch]:
        spans, items = self.search()
        row = 0
        for rows, n_words in zip(self.rows, self.n_words, strict=True):
            earlier = rows.column(name).to_pylist()
            out = []
            for k, (n, before) in enumerate(zip(n_words.tolist(), earlier, strict=True)):
                mine, ids = spans.get(row + k, []), items.get(row + k, set())
                if before:
                    mine = merged(mine + [tuple(s[f] for f in ("first_word", "end_word", "start", "end")) for s in before["spans"]])
                    ids = ids | set(before["items"])
                out.append({
                    "n_words": n, "n_hit": sum(s[1] - s[0] for s in mine),
                    "spans": [dict(zip(("first_word", "end_word", "start", "end"), s, strict=True)) for s in mine],
                    "items": sorted(ids)})
            row += len(rows)
            place = rows.schema.get_field_index(name)
            yield rows.set_column(place, pa.field(name, _OVERLAP), pa.array(out, _OVERLAP))
        self.clear()


def merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans that touch or overlap in words become one."""
    out: list[tuple[int, int, int, int]] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            first, end, start, stop = out[-1]
            out[-1] = (first, max(end, s[1]), start, max(stop, s[3]))
        else:
            out.append(s)
    return out


def overlaps(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", name: str = "overlap",
    window: int = WINDOW, block_bytes: int = 8 << 20,
) -> DataFrame:
    """``docs`` with a struct ``name``: n_words, n_hit (words inside an occurrence), spans
    (words [first_word, end_word), characters [start, end)), items (ids, sorted)."""
    out = docs.drop(name).withColumn(name, F.lit(None).cast(OVERLAP))
    found = False
    for phrases in benchmark_blocks(benchmark, window, block_bytes):
        found = True

        def search(batches: Iterator[pa.RecordBatch], phrases: Phrases = phrases) -> Iterator[pa.RecordBatch]:
            shard = _Shard(phrases, text_col)
            for batch in batches:
                for rows, data, bounds in text_pieces(batch, text_col):
                    shard.add(rows, data, bounds)
                    if shard.full:
                        yield from shard.results(name)
            yield from shard.results(name)

        out = out.mapInArrow(search, out.schema)
    if not found:
        words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
        out = out.withColumn(name, F.struct(
            words.cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
            F.array().cast(T.ArrayType(SPAN)).alias("spans"),
            F.array().cast("array<string>").alias("items")))
    return out


def is_contaminated(overlap: Column, share: int = 20) -> Column:
    """At least one word in ``share`` lies in an occurrence."""
    return (overlap["n_hit"] > 0) & (share * overlap["n_hit"] >= overlap["n_words"])


def cut_spans(text: Column, spans: Column) -> Column:
    """The text without its removal spans."""
    start = F.lit(0).cast("int")
    state = F.aggregate(
        spans, F.struct(F.lit("").alias("kept"), start.alias("at")),
        lambda s, x: F.struct(
            F.concat(s["kept"], F.substring(text, s["at"] + 1, x["start"] - s["at"])).alias("kept"),
            x["end"].alias("at")))
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(state["kept"], F.substring(text, state["at"] + 1, F.length(text))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated rows; its columns are unchanged."""
    name = free_name(docs, "overlap_of_benchmark")
    judged = overlaps(docs, benchmark, text_col, name, **options)
    return judged.filter(~is_contaminated(F.col(name))).select(docs.columns)
