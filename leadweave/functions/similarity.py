"""Name similarity on a 0-100 scale, from the indel distance (insertions and deletions):
``100 - 100 * distance / (len(a) + len(b))``. Set arithmetic runs in the JVM; bounds and the
subsequence count run in an Arrow kernel over candidate pairs."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs counted at once.
PAIRS = 2048
SCORERS = ("token_set_ratio", "token_sort_ratio", "ratio")


def words(col: Column) -> Column:
    return F.filter(F.split(F.trim(col), r"\s+"), lambda w: w != "")


def comparison_tokens(col: Column, scorer: str) -> Column:
    """The word list a scorer looks at: a sorted set, a sorted list, or the words as given."""
    if scorer == "token_set_ratio":
        return F.array_sort(F.array_distinct(words(col)))
    if scorer == "token_sort_ratio":
        return F.array_sort(words(col))
    if scorer == "ratio":
        return F.split(col, " ")
    raise ValueError(f"unknown scorer {scorer!r}; choose one of {SCORERS}")


_WORD = 63  # bits used of a machine word: the last takes the carry


def _character_table(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters as numbers from 1, a row per text, 0 after its end; and the lengths."""
    size = np.array([len(t) for t in texts], np.int64)
    table = np.zeros((len(texts), max(int(size.max(initial=0)), 1)), np.uint32)
    table[np.arange(table.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) + 1
    return table, size


def common_lengths(left: list[str], right: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of many pairs at once. The places of a character
    in the left text are bits, ``_WORD`` of them a word; every step takes the next character of
    all right texts and carries from word to word."""
    a, a_size = _character_table(left)
    b, b_size = _character_table(right)
    words = -(-a.shape[1] // _WORD)
    blocks = np.zeros((len(a), words, 64), np.uint32)
    for w in range(words):
        part = a[:, w * _WORD : (w + 1) * _WORD]
        blocks[:, w, : part.shape[1]] = part
    full = np.uint64((1 << _WORD) - 1)
    row = np.full((len(a), words), full)
    for k in range(b.shape[1]):
        ch = b[:, k]
        # a text that has ended hits nothing, which leaves its row as it is
        hit = np.packbits((blocks == ch[:, None, None]) & (ch > 0)[:, None, None], axis=2, bitorder="little").view("<u8")[:, :, 0]
        carry = np.zeros(len(a), np.uint64)
        for w in range(words):
            both = row[:, w] & hit[:, w]
            total = row[:, w] + both + carry
            carry = total >> np.uint64(_WORD)
            row[:, w] = (total & full) | (row[:, w] & ~both)
    # bits that were cleared are places of the subsequence; those beyond a text are never hit
    return (words * _WORD - np.bitwise_count(row).sum(axis=1)).astype(np.int64)


def _score_batches(cutoff: float, any_order: bool):
    """Kernel over batches of (i, j, shared, l, r): what two names share as a length, and the
    rest of each. Only pairs that the bounds leave open are counted, those of similar length
    together."""

    def run(batches):
        for batch in batches:
            shared = batch["shared"].to_numpy()
            l_len, r_len = batch["l"].str.len().to_numpy(), batch["r"].str.len().to_numpy()
            gap = (shared > 0).astype("int64")
            total = 2 * (shared + gap) + l_len + r_len
            best = np.zeros(len(batch))
            if any_order:
                for rest in (l_len, r_len):
                    extra = rest + gap
                    ratio = 100.0 - 100.0 * extra / np.maximum(2 * shared + extra, 1)
                    best = np.where(shared > 0, np.maximum(best, ratio), best)
                best = np.where((shared > 0) & ((l_len == 0) | (r_len == 0)), 100.0, best)
            # the length gap is the least distance two rests can have
            bound = 100.0 - 100.0 * np.abs(l_len - r_len) / np.maximum(total, 1)
            still_open = (bound >= cutoff) & (bound > best) & (total > 0)
            left, right = batch["l"].to_numpy(), batch["r"].to_numpy()
            pairs = np.flatnonzero(still_open)
            pairs = pairs[np.argsort(np.maximum(l_len[pairs], r_len[pairs]), kind="stable")]
            for at in range(0, len(pairs), PAIRS):
                k = pairs[at : at + PAIRS]
                distance = l_len[k] + r_len[k] - 2 * common_lengths(list(left[k]), list(right[k]))
                best[k] = np.maximum(best[k], 100.0 - 100.0 * distance / total[k])
            keep = best >= cutoff
            yield pd.DataFrame({
                "i": batch["i"][keep], "j": batch["j"][keep],
                "score": np.floor(best[keep] + 0.5).astype("int32"),
            })

    return run


def score_pairs(pairs: DataFrame, cutoff: float, scorer: str = "token_set_ratio") -> DataFrame:
    """(i, j, score) of the ``pairs(i, j, i_tokens, j_tokens)`` that reach ``cutoff``.

    The unrounded value meets the cutoff; the score is rounded to the nearest integer.
    """
    l, r = F.col("i_tokens"), F.col("j_tokens")
    any_order = scorer == "token_set_ratio"
    if any_order:
        columns = [
            F.length(F.array_join(F.array_intersect(l, r), " ")).cast("bigint").alias("shared"),
            F.array_join(F.array_except(l, r), " ").alias("l"),
            F.array_join(F.array_except(r, l), " ").alias("r"),
        ]
    else:
        columns = [F.lit(0).cast("bigint").alias("shared"),
                   F.array_join(l, " ").alias("l"), F.array_join(r, " ").alias("r")]
    return pairs.select("i", "j", *columns).mapInPandas(
        _score_batches(float(cutoff), any_order), "i bigint, j bigint, score int"
    )
