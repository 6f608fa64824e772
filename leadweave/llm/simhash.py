"""SimHash near-duplicates by pivot distance tables.

Every text gets a 64-bit fingerprint: a bit is 1 where over half of the XXH64 values of its
word shingles have it. Fingerprints within ``max_bits`` are linked; a component is everything
reachable by links.

The 64 bits are cut into ``max_bits + 2`` blocks, each with a table of reference fingerprints.
A fingerprint's coordinates are its Hamming distances to the references of every block. Two
fingerprints within ``max_bits`` agree entirely in at least two blocks, so all their
coordinates there are equal: fingerprints meet where the coordinates of two blocks are equal,
one meeting for every pair of blocks. Where they meet, pairs are taken in order of the
distance to one more reference, so that only a window of ``max_bits`` to either side is open;
of those, pairs whose coordinates differ by too much (the largest difference of each block,
summed over blocks, is a lower bound of the distance) are discarded, and the survivors are
verified bit by bit. No pair within the distance is lost.

Equal fingerprints are one node. Members of one meeting are split into cells of about
``CELL`` members; a meeting of k cells' worth is checked by k * (k + 1) / 2 tasks, and each
emits at most one link per member, a spanning forest of what it verified. Links are closed to
components by alternating large-star and small-star steps over written tables.

Defined results: NULL, empty and wordless texts have fingerprint 0 and are linked like any
other. Repeated doc_ids are judged by each row; NULL doc_ids take part but name no component
unless nothing else is in it. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.llm.common import packed, run_starts, text_pieces, unpacked, written

CELL = 1024
REFERENCES = 8
_SEED = 42


# --- fingerprints --------------------------------------------------------------------------


def fingerprint_arrays(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """Fingerprints of UTF-8 texts as unsigned numbers. Votes are counted by byte value: for
    each of the eight bytes of a hash, a histogram per text, times the bits of each value."""
    hashes, counts = [], []
    for text in texts:
        words = text.lower().split()
        if 0 < len(words) < shingle:
            grams = [words]
        else:
            grams = zip(*(words[k:] for k in range(shingle)))
        n = max(len(words) - shingle + 1, 1 if words else 0)
        hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(_SEED)), np.uint64, n))
        counts.append(n)
    n = np.array(counts, np.int64)
    values = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(n)) * 256, n)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
    out = np.zeros(len(n), np.uint64)
    for byte in range(8):
        at = owner + ((values >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)
        votes = np.bincount(at, minlength=256 * len(n)).reshape(len(n), 256) @ bits
        ones = (2 * votes > n[:, None]).astype(np.uint64)
        for bit in range(8):
            out |= ones[:, bit] << np.uint64(8 * byte + bit)
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3, keep: tuple[str, ...] = ("doc_id",), name: str = "fingerprint") -> DataFrame:
    """The columns ``keep`` with the fingerprint in ``name`` (bigint, the same 64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in text_pieces(batch, "_text"):
                held = data.tobytes()
                texts = [held[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                prints = fingerprint_arrays(texts, shingle).view(np.int64)
                yield pa.record_batch([*rows.columns[:-1], pa.array(prints)], [*rows.schema.names[:-1], name])

    given = docs.select(*keep, F.col(text_col).alias("_text"))
    kept = docs.select(*keep, F.lit(0).cast("long").alias(name))
    return given.mapInArrow(run, kept.schema)


def hex_of(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


# --- pivot tables --------------------------------------------------------------------------


def blocks_of(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of max_bits + 2 blocks of the 64 bits."""
    n = max_bits + 2
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def pivots(max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks (blocks,) and references (blocks, REFERENCES), each reference within its block."""
    masks = np.array([((1 << w) - 1) << a for a, w in blocks_of(max_bits)], np.uint64)
    drawn = np.random.default_rng(7).integers(0, 1 << 63, (len(masks), REFERENCES), dtype=np.uint64)
    return masks, (drawn ^ (drawn << np.uint64(1))) & masks[:, None]


def coordinates(prints: np.ndarray, max_bits: int) -> np.ndarray:
    """Distances to every reference: (n, blocks, REFERENCES)."""
    masks, references = pivots(max_bits)
    return np.bitwise_count((prints[:, None, None] & masks[:, None]) ^ references)


def _signed(x: int) -> int:
    return int(np.uint64(x).view(np.int64))


def _meetings(nodes: DataFrame, max_bits: int) -> DataFrame:
    """One row per fingerprint and pair of blocks: the pair, the coordinates of either block
    packed into a number, the distance to the reference that orders a meeting."""
    masks, references = pivots(max_bits)
    fp = F.col("fingerprint")
    packed, order = [], F.lit(0)
    for mask, refs in zip(masks, references, strict=True):
        distances = [F.bit_count(fp.bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(F.lit(_signed(r)))) for r in refs]
        code = F.lit(0).cast("long")
        for k, d in enumerate(distances):
            code = code + F.shiftleft(d.cast("long"), 7 * k)
        packed.append(code)
        order = order + distances[0]
    coded = nodes.select("fingerprint", F.array(*packed).alias("codes"), order.cast("int").alias("near"))
    pairs = F.array(*[
        F.struct(F.lit(k).alias("pair"), F.col("codes")[a].alias("a"), F.col("codes")[b].alias("b"))
        for k, (a, b) in enumerate(combinations(range(len(masks)), 2))])
    return coded.select("fingerprint", "near", F.inline(pairs))


def verified_links(prints: np.ndarray, near: np.ndarray, group: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``max_bits`` of rows sorted by (group, near): compared at growing
    shifts, a row drops out once its group or its window of ``near`` is left."""
    table = coordinates(prints, max_bits).astype(np.int8)
    lefts, rights = [], []
    open_rows, shift = np.arange(len(prints) - 1), 1
    while len(open_rows):
        open_rows = open_rows[open_rows + shift < len(prints)]
        other = open_rows + shift
        live = (group[open_rows] == group[other]) & (near[other] - near[open_rows] <= max_bits)
        open_rows, other = open_rows[live], other[live]
        bound = np.abs(table[open_rows] - table[other]).max(axis=2).sum(axis=1, dtype=np.int64)
        i, j = open_rows[bound <= max_bits], other[bound <= max_bits]
        close = np.bitwise_count(prints[i] ^ prints[j]) <= max_bits
        lefts.append(i[close])
        rights.append(j[close])
        shift += 1
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *lefts]), np.concatenate([empty, *rights])


def _least_reachable(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For every row the least row reachable over the links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        for side in (left, right):
            np.minimum.at(label, side, low)
            np.minimum.at(label, before[side], low)
        label = label[label]
        if (label == before).all():
            return label


def _check_cells(max_bits: int):
    """Sorted rows of cells to a spanning forest of their links. A cell that a batch cuts is
    carried into the next one; it has about 2 * CELL rows at most."""

    def links(block: pa.Table) -> pa.RecordBatch:
        key = [block.column(c).to_numpy() for c in ("pair", "a", "b", "i", "j")]
        prints = block.column("fingerprint").to_numpy()
        group = np.cumsum(run_starts(*key))
        left, right = verified_links(prints.view(np.uint64), block.column("near").to_numpy(), group, max_bits)
        root = _least_reachable(len(prints), left, right)
        moved = np.flatnonzero(root != np.arange(len(prints)))
        return pa.record_batch({"u": pa.array(prints[moved]), "v": pa.array(prints[root[moved]])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            block = pa.Table.from_batches(held)
            starts = np.flatnonzero(run_starts(*[block.column(c).to_numpy() for c in ("pair", "a", "b", "i", "j")]))
            cut = int(starts[-1])
            if cut:
                yield links(block.slice(0, cut))
            held = block.slice(cut).combine_chunks().to_batches()
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def near_links(nodes: DataFrame, max_bits: int = 3, cell: int = CELL) -> DataFrame:
    """Links (u, v) between distinct fingerprints that join exactly what is within
    ``max_bits``, directly or over other links. ``nodes`` is a written table."""
    key = ["pair", "a", "b"]
    met = _meetings(nodes, max_bits)
    shared = written(met.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "meetings")
    parts = F.ceil(F.col("n") / cell).cast("int")
    mine = F.pmod(F.xxhash64("fingerprint", F.lit(1)), F.col("parts")).cast("int")
    cells = (
        met.join(shared, key).withColumn("parts", parts).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(*key, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "near", "fingerprint"))
    whole = [*key, "i", "j"]
    return cells.repartition(*whole).sortWithinPartitions(*whole, "near", "fingerprint").mapInArrow(
        _check_cells(max_bits), "u bigint, v bigint").distinct()


# --- components ----------------------------------------------------------------------------


#: Edges that one task takes in a step; fewer would be a file a task of next to nothing.
EDGES = 20_000


def _star(edges: DataFrame, small: bool, parts: int) -> DataFrame:
    """One step over edges (u, v), u > v: neighbours move to the least of their neighbourhood.
    Large: every node hands its larger neighbours over. Small: its smaller ones and itself. It is
    written in ``parts`` files at most, and so is what it writes on the way."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(parts), "least")
    if small:
        moved = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
    else:
        moved = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return written(moved.filter("u <> v").distinct().coalesce(parts), "small" if small else "large")


def roots(links: DataFrame) -> DataFrame:
    """(u, root) for every node of a link but the roots: the least node reachable."""
    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1000003)).first())

    known = state(edges)
    while known[0]:
        parts = known[0] // EDGES + 1  # no step makes more edges than there were
        edges = _star(_star(edges, small=False, parts=parts), small=True, parts=parts)
        now = state(edges)
        if now == known:
            break
        known = now
    return edges.withColumnRenamed("v", "root")


def components(docs: DataFrame, text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (bigint), root (least fingerprint reachable), component_id (least
    doc_id reachable), one row per row."""
    prints = written(fingerprints(docs, text_col, shingle), "fingerprints")
    nodes = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "nodes")
    linked = written(roots(near_links(nodes, max_bits)).withColumnRenamed("u", "fingerprint"), "roots")
    rooted = nodes.join(linked, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "components")
    named = written(rooted.join(least, "root").select("fingerprint", "root", "component_id"), "named")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "root", "component_id")


def one_of_each(docs: DataFrame, text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` with one row of each component, columns unchanged: a row of the least doc_id
    and, of rows that repeat it there, one of the least fingerprint; of a component without any
    doc_id, a row of its least fingerprint."""
    judged = written(components(docs, text_col, shingle, max_bits), "judged")
    chosen = judged.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", F.col("doc_id").alias("id")).agg(
        F.min("fingerprint").alias("print"))
    # an id that one row in all bears names its row; others are told apart by their fingerprint
    repeated = written(judged.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "repeated-ids")
    given = docs.select(packed(docs).alias("given"), F.col("doc_id").alias("own"), F.col(text_col).alias("body"))
    alone = written(chosen.filter("id is not null").join(repeated, "id", "left_anti").select("id"), "chosen")
    # texts are met by id in one way at every size: merged, never against a broadcast of ids
    single = given.select("given", "own").join(alone.hint("merge"), F.col("own") == F.col("id")).select(unpacked(docs.columns))
    several = written(chosen.join(repeated, "id", "left_semi").unionByName(chosen.filter("id is null")).select("id", "print"), "told-apart")
    if several.isEmpty():
        return single
    ids = several.select("id").distinct()
    again = given.join(ids, F.col("own").eqNullSafe(F.col("id")), "left_semi")
    printed = fingerprints(again, "body", shingle, ("given", "own"), "own_print")
    met = printed.join(several, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_print") == F.col("print")))
    return single.unionByName(met.dropDuplicates(["id", "print"]).select(unpacked(docs.columns)))
