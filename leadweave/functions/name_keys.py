"""Join keys of company names, such that similar names share one and few others do.

Let r = cutoff/100. Two names reach the cutoff in one of two ways, each with keys of its own.

*Containment* (``token_set_ratio``): one token set lies in the other but for a rest so short
that the shared part is at least r/(2-r) of its length. Walk the tokens of the larger set,
rarest first. Once any one of those seen and all not yet seen are too short for that share, two
of those seen must be shared: the pairs among them are its probes. Where one token alone is long
enough the tokens are probes themselves, up to where those not yet seen are too short.

*Edits*: the texts differ by D insertions and deletions at most, D <= 2(1-r) * length of the
longer. Its tokens, each with a blank before it, are cut into pieces that don't overlap; an edit
spoils one piece at most, so of D + s different pieces s stand inside a token of the shorter.

* s is 3 where the name has that many bigrams. They are chosen so that their measured
  frequencies in the block are least in sum. Any two of them would do as a key; a pair that
  many names should hold, by the frequencies of its bigrams (``HOT`` names or more if they were
  independent), is replaced by the triples it is in. Whether a pair is hot follows from the block's
  frequencies alone, so both sides agree: of three surviving pieces, either a pair is not hot and
  both sides have it, or all pairs are, and both have the triple. So the names that meet under a
  key stay few as names become many.
* s is 2: all pairs of the pieces. s is 1, or the name is longer than ``LONGEST``: single pieces,
  as long as the name allows.
* Names for which no piece is sure to survive, and names of groups (block and band) in which
  comparing all would cost less than these keys, probe the group as a whole, cell by cell: a
  group's names are dealt to cells by a hash, and a cell is one index key.

Edit keys hold the length band: lengths of a matching pair differ at most by the factor
(2-r)/r, so bands differ by at most one. Keys are 64-bit hashes of (block, kind, texts, band); a
collision only adds a candidate that the score rejects. The lowest bit tells containment keys
(1) from edit keys (0)."""

import math
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import combinations

import numpy as np
import pandas as pd

LONGEST = 40
HOT = 4.0
ROWS = 512
GROUP = ("band", "whole", "whole_above", "cell", "cells", "cells_below", "names")
_WILD, _SINGLE, _PAIR, _TRIPLE, _TOKEN, _TWO_TOKENS = range(6)
_MASK = (1 << 64) - 1


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@lru_cache(1 << 16)
def _number(text: str) -> int:
    """64 bits of a short text."""
    h = 0xCBF29CE484222325
    for ch in text:
        h = ((h ^ ord(ch)) * 0x100000001B3 + 0x9E37) & _MASK
    return h ^ (h >> 29)


class NameKeys:
    """Keys for one cutoff and scorer."""

    def __init__(self, cutoff: float, scorer: str):
        self.r = cutoff / 100.0
        self.contained = scorer == "token_set_ratio"
        self.sizes = (3, 2) if cutoff >= 85 else (3, 2, 1)
        self.combined = cutoff >= 85
        self.log_factor = math.log((200.0 - cutoff) / cutoff * 1.0001)

    # --- parts of a name -------------------------------------------------------------------

    def band(self, length: int) -> int:
        return math.floor(math.log(max(length, 1)) / self.log_factor)

    def edits(self, length: int) -> int:
        return math.floor(2 * (1 - self.r) * length + 1e-9)

    @staticmethod
    def grams(tokens: list[str], size: int) -> Iterator[str]:
        for token in tokens:
            padded = " " + token
            for i in range(len(padded) - size + 1):
                yield padded[i : i + size]

    @staticmethod
    def chosen_bigrams(tokens: list[str], frequency: dict[str, float], wanted: int) -> list[str]:
        """``wanted`` bigrams that don't overlap, of the least sum of frequencies; as many as
        there are if there are fewer."""
        far = float("inf")
        best: list[list[float]] = [[0.0] + [far] * wanted]
        place: list[tuple[str, int]] = []  # bigram that ends here, place before it
        for token in tokens:
            padded = " " + token
            base = len(best) - 1
            for end in range(1, len(padded) + 1):
                row, gram = list(best[-1]), ""
                if end > 1:
                    gram = padded[end - 2 : end]
                    cost, before = frequency.get(gram, 0.0), best[base + end - 2]
                    for k in range(wanted):
                        if before[k] + cost < row[k + 1]:
                            row[k + 1] = before[k] + cost
                best.append(row)
                place.append((gram, base + end - 2))
        k = max(i for i, v in enumerate(best[-1]) if v < far)
        out, at = [], len(best) - 1
        while k:
            while best[at - 1][k] == best[at][k]:
                at -= 1
            gram, at = place[at - 1]
            out.append(gram)
            k -= 1
        return out

    def single_pieces(self, tokens: list[str], frequency: dict[str, float], wanted: int) -> list[str] | None:
        """``wanted`` pieces of one size, the longest the name allows, the rarest of them."""
        for size in self.sizes:
            cut = [(" " + t)[i : i + size] for t in tokens for i in range(0, len(t) + 2 - size, size)]
            if len(cut) >= wanted:
                return sorted(cut, key=lambda g: frequency.get(g, 0.0))[:wanted]
        return None

    # --- keys ------------------------------------------------------------------------------

    def piece_lists(self, tokens: list[str], frequency: dict[str, float]) -> tuple[int, list[str]]:
        """Of one name how many of the pieces survive at least (0: none is sure to), and the pieces."""
        length = sum(map(len, tokens)) + max(len(tokens) - 1, 0)
        edits = self.edits(length)
        if self.combined and length <= LONGEST:
            pieces = set(self.chosen_bigrams(tokens, frequency, edits + 3))
            if len(pieces) < edits + 3:
                pieces = set(self.chosen_bigrams(tokens, frequency, length))
            if len(pieces) - edits >= 2:
                return min(len(pieces) - edits, 3), list(pieces)
        single = self.single_pieces(tokens, frequency, edits + 1)
        return 0 if single is None else 1, list(set(single or ()))

    def containment(self, tokens: list[str], frequency: dict[str, int]) -> tuple[list[str], int]:
        """Tokens, rarest first, and how many of them are probes: singly if positive, in pairs if
        negative."""
        rare = sorted(tokens, key=lambda t: (frequency[t], t))
        sizes = [len(t) for t in rare]
        must = (sum(sizes) + len(sizes) - 1) * self.r / (2 - self.r) - 1e-9
        for i in range(2, len(rare) + 1):
            rest = sizes[i:]
            if max(sizes[:i]) + len(rest) + sum(rest) < must:
                return rare, -i
        return rare, max((k + 1 for k in range(len(rare)) if not k or sum(sizes[k:]) + len(sizes) - k - 1 >= must), default=0)

    def batch_keys(
        self, blocks: list[str], names: list[list[str]], groups: dict[str, np.ndarray], of_tokens: list[dict], of_pieces: list[dict],
    ) -> tuple[list, list]:
        """(probe, index) keys of each name. ``groups``, by name: ``band``, ``whole`` (its group is probed as a
        whole), ``whole_above`` (so is that of the next band), ``cell`` (its own), ``cells`` and
        ``cells_below`` (of its group and the band below), ``names`` (of its block). Then how
        many names of the block hold its tokens, its pieces."""
        block = np.array([_number(b) for b in blocks], np.uint64)
        total = groups["names"].astype(float)
        lists = [(0, []) if whole else self.piece_lists(t, f) for t, f, whole in zip(names, of_pieces, groups["whole"], strict=True)]
        band = groups["band"].astype(np.int64)
        survive = np.array([x[0] for x in lists])
        probe, index = _Keys(block), _Keys(block)
        everyone = np.arange(len(names))
        index.add(_WILD, band, everyone, groups["cell"].astype(np.uint64)[:, None])
        lost = np.flatnonzero(survive == 0)
        for at, cells in ((band, groups["cells"]), (band - 1, groups["cells_below"])):
            if len(lost):
                cell = np.arange(int(cells[lost].max()))[None, :]
                probe.add(_WILD, at, lost, np.repeat(cell, len(lost), 0).astype(np.uint64), only=cell < cells[lost][:, None])
        asked = np.flatnonzero(~(groups["whole"] & groups["whole_above"]))
        singles = [sorted({g for size in self.sizes for g in self.grams(t, size)}) for t in names]
        for rows, numbers, _ in _by_size(asked, singles, of_pieces):
            index.add(_SINGLE, band, rows, numbers)
        for rows, numbers, _ in _by_size(np.flatnonzero(survive == 1), [x[1] for x in lists], of_pieces):
            for at in (band, band - 1):
                probe.add(_SINGLE, at, rows, numbers)
        if self.combined:
            # a name of this band meets probes of its band and the next
            near = asked[band[asked] <= self.band(LONGEST)]
            for rows, numbers, held in _by_size(near, [sorted(set(self.grams(t, 2))) for t in names], of_pieces):
                pairs, _, triples, hot = _combined(held, total[rows])
                index.add(_PAIR, band, rows, *(numbers[:, k] for k in pairs))
                index.add(_TRIPLE, band, rows, *(numbers[:, k] for k in triples), only=hot)
            for rows, numbers, held in _by_size(np.flatnonzero(survive >= 2), [x[1] for x in lists], of_pieces):
                pairs, warm, triples, hot = _combined(held, total[rows])
                three = (survive[rows] == 3)[:, None]
                for at in (band, band - 1):
                    probe.add(_PAIR, at, rows, *(numbers[:, k] for k in pairs), only=~(warm & three))
                    probe.add(_TRIPLE, at, rows, *(numbers[:, k] for k in triples), only=hot & three)
        if self.contained:
            found = [self.containment(t, f) for t, f in zip(names, of_tokens, strict=True)]
            none = np.zeros(len(names), np.int64)
            for rows, numbers, _ in _by_size(everyone, [x[0] for x in found], of_pieces, ordered=False):
                size = numbers.shape[1]
                many = np.array([found[r][1] for r in rows])[:, None]
                a, b = np.triu_indices(size, 1)
                low, high = np.minimum(numbers[:, a], numbers[:, b]), np.maximum(numbers[:, a], numbers[:, b])
                index.add(_TOKEN, none, rows, numbers)
                index.add(_TWO_TOKENS, none, rows, low, high)
                probe.add(_TOKEN, none, rows, numbers, only=np.arange(size) < many)
                probe.add(_TWO_TOKENS, none, rows, low, high, only=b < -many)
        return probe.lists(len(names)), index.lists(len(names))

    def run(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Over batches of (rep, block, tokens, members, GROUP, known), ``known`` holding (kind, text,
        n): how many names of the block hold the name's tokens (kind 1) and pieces (2)."""
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.iloc[at : at + ROWS]
                of_tokens, of_pieces = [], []
                for known in batch["known"]:
                    of_tokens.append({x["text"]: x["n"] for x in known if x["kind"] == 1})
                    of_pieces.append({x["text"]: x["n"] for x in known if x["kind"] == 2})
                out = batch.drop(columns=["known", *GROUP])
                out["probe"], out["index"] = self.batch_keys(
                    list(batch["block"]), [list(t) for t in batch["tokens"]], {c: batch[c].to_numpy() for c in GROUP}, of_tokens, of_pieces)
                yield out


class _Keys:
    """Keys of a batch of names as they are found: rows and hashes."""

    def __init__(self, block: np.ndarray):
        self.block, self.rows, self.found = block, [], []

    def add(self, kind: int, band: np.ndarray, rows: np.ndarray, *parts: np.ndarray, only: np.ndarray | None = None) -> None:
        """Keys of ``rows``: one for each column of ``parts`` (rows by keys); one without parts."""
        with np.errstate(over="ignore"):
            h = _spread(self.block[rows] * np.uint64(31) + np.uint64(kind + 1) * np.uint64(0x9E3779B97F4A7C15)
                        + band[rows].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[:, None]
            row = np.broadcast_to(rows[:, None], parts[0].shape if parts else h.shape)
            if only is not None:
                only = np.broadcast_to(only, row.shape)
                h, row, parts = np.broadcast_to(h, row.shape)[only], row[only], [c[only] for c in parts]
            for c in parts:
                h = _spread(h * np.uint64(0x9FB21C651E98DF25) + c)
        self.rows.append(row.ravel())
        self.found.append(((h & ~np.uint64(1)) | np.uint64(kind >= _TOKEN)).ravel())

    def lists(self, n: int) -> list[np.ndarray]:
        """The distinct keys of every row."""
        row, key = np.concatenate(self.rows), np.concatenate(self.found)
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        row, key = row[new], key[new].view(np.int64)
        return np.split(key, np.searchsorted(row, np.arange(1, n)))


def _by_size(rows: np.ndarray, texts: list[list[str]], counted: list[dict], ordered: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with equally many texts together: (rows, their numbers, how many names hold them),
    the texts of a row in order of their number if ``ordered``."""
    sizes: dict[int, list[int]] = {}
    for r in rows.tolist():
        sizes.setdefault(len(texts[r]), []).append(r)
    for size, same in sizes.items():
        if not size:
            continue
        numbers = np.array([[_number(t) for t in texts[r]] for r in same], np.uint64)
        held = np.array([[counted[r].get(t, 0.0) for t in texts[r]] for r in same], float)
        if ordered:
            order = np.argsort(numbers, axis=1)
            numbers, held = np.take_along_axis(numbers, order, 1), np.take_along_axis(held, order, 1)
        yield np.array(same), numbers, held


@cache
def _places(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and triples of n places in order, and for every triple its three pairs."""
    pairs = list(combinations(range(n), 2))
    number = {p: k for k, p in enumerate(pairs)}
    triples = list(combinations(range(n), 3))
    inside = [[number[a, b], number[a, c], number[b, c]] for a, b, c in triples]
    shape = lambda x, m: np.array(x, np.int32).reshape(-1, m).T
    return shape(pairs, 2), shape(triples, 3), shape(inside, 3)


def _combined(held: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of all pairs, which of them are hot (rows by pairs), of all triples, and of which
    of those all pairs are."""
    pairs, triples, inside = _places(held.shape[1])
    hot = held[:, pairs[0]] * held[:, pairs[1]] >= HOT * names[:, None]
    return pairs, hot, triples, hot[:, inside[0]] & hot[:, inside[1]] & hot[:, inside[2]]
