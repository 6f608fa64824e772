"""Fuzzy deduplication of company names.

Names meet only inside a block (first letter). In ``ord`` order, every record that is still
alive absorbs later ones scoring ``auto`` or more and marks later ones from ``review`` up. A
record that absorbs is a *leader*: it has no earlier leader scoring ``auto`` against it.

How this stays exact without comparing all pairs of a block:

* Names with the same comparison tokens score alike against everything, so only distinct
  token lists are compared, each standing for its first record.
* Candidates come from equi-joins on lossless keys, which become more special as the names of
  a block become more (see ``functions.name_keys``).
* Distinct names are settled in growing ``ord`` prefixes. A prefix depends on nothing after
  it, so its leaders are final; they meet the rest once, and whatever they absorb is gone
  before the next prefix. Pairs between two absorbed names, the bulk of a large cluster,
  are therefore never formed.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadweave.functions.name_keys import GROUP, NameKeys
from leadweave.functions.names import block_key
from leadweave.functions.similarity import comparison_tokens, score_pairs
from leadweave.operators.exact_dedup import merge_groups
from leadweave.session import cut_lineage, salted_join

AUTO_MERGE = 90
REVIEW = 85


def name_classes(df: DataFrame, scorer: str = "token_set_ratio") -> DataFrame:
    """Distinct comparison tokens per block: (block, tokens, rep, members); ``rep`` is the
    smallest ``ord``. Rows without a normalised name are left out. Equal names are counted
    first, so that only distinct ones are cut into tokens."""
    name = F.col("company_name_normalized")
    distinct = df.filter(name != "").groupBy(name).agg(
        F.min("ord").alias("rep"), F.count(F.lit(1)).alias("members"))
    return distinct.select(
        block_key(name).alias("block"), comparison_tokens(name, scorer).alias("tokens"), "rep", "members"
    ).filter(F.size("tokens") > 0).groupBy("block", "tokens").agg(
        F.min("rep").alias("rep"), F.sum("members").alias("members")
    )


def with_keys(
    classes: DataFrame, cutoff: float = REVIEW, scorer: str = "token_set_ratio", whole: bool | None = None
) -> DataFrame:
    """Classes with their length, signatures and join keys, the arrays ``probe`` and ``index``:
    of two names that reach the cutoff, the longer has a probe among the other's index keys.
    Groups of equal block and length band are compared as a whole if ``whole``, by keys if not,
    or by what is measured to cost less (None); the pairs are the same."""
    keys = NameKeys(float(cutoff), scorer)
    sized = cut_lineage(classes.select("rep", "block", "tokens", "members", _length_band(keys).alias("band")))
    given = None if whole is None else sized.groupBy("block", "band").agg(F.count(F.lit(1)).alias("n")).withColumn("whole", F.lit(whole))
    groups = cut_lineage(name_groups(sized, given))
    if whole is False:
        known = measured(sized, F.lit(True))
    elif groups.filter("not whole").isEmpty():
        known = measured(sized, F.lit(False))
    else:
        # a first measure of what keys would cost: a few hundred names of each group meet each other
        every = F.greatest(F.floor(F.col("n") / SAMPLE), F.lit(1))
        some = _grouped(sized, groups).filter(~F.col("whole") & (F.pmod(F.xxhash64("rep"), every) == 0))
        counts = cut_lineage(_counts(_parts(sized, F.lit(True))))
        tried = some.join(measured(some, F.lit(True), counts), "rep").drop("n").mapInPandas(keys.run, _KEYED)
        tried = cut_lineage(tried.join(some.select("rep", "band"), "rep"))
        met = tried.select(F.explode("probe").alias("key"), F.col("rep").alias("i")).join(
            tried.select(F.explode("index").alias("key"), F.col("rep").alias("j")), "key").filter("i <> j")
        spent = met.groupBy(F.col("i").alias("rep")).agg(F.count(F.lit(1)).alias("hits")).join(
            tried.select("rep", "block", "band"), "rep").groupBy("block", "band").agg(F.sum("hits").alias("hits"))
        asked = tried.groupBy("block", "band").agg(F.count(F.lit(1)).alias("names_asked"))
        cost = asked.join(spent, ["block", "band"], "left").select(
            "block", "band", (F.coalesce("hits", F.lit(0)) / F.col("names_asked") / F.col("names_asked")).alias("share"))
        dear = groups.join(cost, ["block", "band"], "left").select(
            "block", "band", "n", (F.col("whole") | F.coalesce(F.col("share") * F.col("n") > F.col("n") + F.col("n_below"), F.lit(False))).alias("whole"))
        groups = cut_lineage(name_groups(sized, dear))
        wanted = _grouped(sized, groups)
        known = measured(wanted, ~(F.col("whole") & F.col("whole_above")), counts)
    return _grouped(sized, groups).drop("n").join(known, "rep").mapInPandas(keys.run, _KEYED).withColumns({
        "length": F.length(F.array_join("tokens", " ")),
        "signature": _signature(F.col("tokens")),
        "doubles": _doubles(F.col("tokens")),
    })


#: Groups of so few names are compared as a whole; a cell of a group holds about so many names;
#: so many names of a group are tried to see what its keys cost.
FEW, CELL, SAMPLE = 256, 1024, 256
_KEYED = "rep bigint, block string, tokens array<string>, members bigint, probe array<bigint>, index array<bigint>"


def _length_band(keys: NameKeys) -> Column:
    length = F.greatest(F.length(F.array_join("tokens", " ")), F.lit(1)).cast("double")
    return F.floor(F.log(length) / keys.log_factor).cast("int")


def name_groups(sized: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """(block, band, n, n_below, whole, whole_above, cells, cells_below, names), one row per
    group: how many names it and the band below hold, whether it is compared as a whole, and how
    many names its block holds. ``judged``: (block, band, n, whole) where that is known."""
    if judged is None:
        judged = sized.groupBy("block", "band").agg(F.count(F.lit(1)).alias("n")).withColumn("whole", F.lit(None).cast("boolean"))
    # a row per group: a block has as many as there are lengths of names, by powers
    of_block, by_band = Window.partitionBy("block"), Window.partitionBy("block").orderBy("band")
    below = F.when(F.lag("band").over(by_band) == F.col("band") - 1, F.lag("n").over(by_band))
    found = judged.withColumns({
        "n_below": F.coalesce(below, F.lit(0)), "cells": F.ceil(F.col("n") / CELL), "names": F.sum("n").over(of_block)})
    found = found.withColumns({
        "whole": F.coalesce("whole", F.col("n") + F.col("n_below") <= FEW), "cells_below": F.ceil(F.col("n_below") / CELL)})
    above = F.when(F.lead("band").over(by_band) == F.col("band") + 1, F.lead("whole").over(by_band))
    return found.withColumn("whole_above", F.coalesce(above, F.lit(True)))


def _grouped(sized: DataFrame, groups: DataFrame) -> DataFrame:
    """Names with what is known of their group, and their own cell in it."""
    small = groups.select(F.struct("block", "band").alias("_group"), "n", *[c for c in GROUP if c not in ("cell", "band")])
    cell = F.pmod(F.xxhash64("rep", F.lit(1)), F.greatest(F.col("cells"), F.lit(1)))
    return salted_join(sized.withColumn("_group", F.struct("block", "band")), small, "_group", "inner").withColumn("cell", cell).drop("_group")


def _parts(sized: DataFrame, with_pieces: Column) -> DataFrame:
    """(rep, _part): the tokens (kind 1) and pieces (2) of every name, each once."""
    tokens = F.col("tokens")
    none = F.array().cast("array<string>")
    pieces = F.when(with_pieces, F.array_distinct(F.concat(*[_pieces(tokens, size) for size in (3, 2)]))).otherwise(none)
    parts = F.concat(
        F.transform(F.array_distinct(tokens), lambda t: F.struct(F.lit(1).alias("kind"), t.alias("text"))),
        F.transform(pieces, lambda t: F.struct(F.lit(2).alias("kind"), t.alias("text"))))
    return sized.select("rep", "block", F.inline(parts)).select("rep", F.struct("block", "kind", "text").alias("_part"))


def _counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))


def measured(sized: DataFrame, with_pieces: Column, counts: DataFrame | None = None) -> DataFrame:
    """(rep, known): how many names of its block hold each of a name's tokens and, where asked
    for, pieces."""
    held = _parts(sized, with_pieces)
    return salted_join(held, _counts(held) if counts is None else counts, "_part", "inner").groupBy("rep").agg(
        F.collect_list(F.struct("_part.kind", "_part.text", "n")).alias("known"))


def _pieces(tokens: Column, size: int) -> Column:
    """Pieces of ``size`` characters of every token, a blank standing for its start."""
    def cut(token):
        padded = F.concat(F.lit(" "), token)
        starts = F.sequence(F.lit(1), F.length(padded) - size + 1)
        return F.when(
            F.length(padded) >= size,
            F.transform(starts, lambda i: F.substring(padded, i, F.lit(size))),
        ).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(tokens, cut))


def _signature(tokens: Column) -> Column:
    """The characters of a name as bits; two that share a bit only make names look closer."""
    places = F.array_distinct(F.transform(F.split(F.array_join(tokens, ""), ""), lambda c: F.ascii(c) % 64))
    return F.aggregate(places, F.lit(0).cast("bigint"), lambda n, k: n.bitwiseOR(
        F.call_function("shiftleft", F.lit(1).cast("bigint"), k)))


def _doubles(tokens: Column) -> Column:
    """The characters that a name holds twice or more, as bits."""
    letters = F.array_sort(F.split(F.array_join(tokens, ""), ""))
    again = F.filter(letters, lambda c, i: (i > 0) & (F.get(letters, i - 1) == c))
    places = F.array_distinct(F.transform(again, lambda c: F.ascii(c) % 64))
    return F.aggregate(places, F.lit(0).cast("bigint"), lambda n, k: n.bitwiseOR(
        F.call_function("shiftleft", F.lit(1).cast("bigint"), k)))


def _keyed(classes: DataFrame, keys: str, name: str) -> DataFrame:
    return classes.select(F.explode(keys).alias("key"), F.col("rep").alias(name), *[
        F.col(c).alias(f"{name}_{c}") for c in ("length", "signature", "doubles")])


def scored_pairs(
    earlier: DataFrame, later: DataFrame, cutoff: float = REVIEW, scorer: str = "token_set_ratio"
) -> DataFrame:
    """(i, j, score) with i < j for all pairs reaching ``cutoff`` between two sets of classes
    with keys. The key joins carry ids, lengths and signatures only; a pair met under several
    keys is folded before its texts are looked up and scored. Adaptive execution splits the
    partitions of hot keys."""
    contained = F.col("key").bitwiseAND(F.lit(1)) == 1
    r = cutoff / 100.0
    found = None
    for i_keys, j_keys, prober, other in (("probe", "index", "i", "j"), ("index", "probe", "j", "i")):
        length, mine, theirs = F.col(f"{prober}_length"), F.col(f"{prober}_signature"), F.col(f"{other}_signature")
        # each edit brings or takes one character, so it changes one bit at most of those that say
        # which characters are there once and twice; what is not shared of a contained set is as
        # long as the characters it alone has
        changed = F.bit_count(mine.bitwiseXOR(theirs)) + F.bit_count(F.col("i_doubles").bitwiseXOR(F.col("j_doubles")))
        near = (length >= F.col(f"{other}_length")) & (changed <= F.floor(2 * (1 - r) * length + 1e-9))
        within = F.bit_count(mine.bitwiseAND(F.bitwise_not(theirs))) <= length * (2 - 2 * r) / (2 - r) + 1
        hits = _keyed(earlier, i_keys, "i").join(_keyed(later, j_keys, "j"), "key").filter(
            (F.col("i") < F.col("j")) & F.when(contained, within).otherwise(near)
        ).select("i", "j")
        found = hits if found is None else found.unionByName(hits)
    texts = [
        side.select(F.col("rep").alias(name), F.col("tokens").alias(f"{name}_tokens"), F.col("block").alias(f"{name}_block"))
        for side, name in ((earlier, "i"), (later, "j"))
    ]
    pairs = found.distinct().join(texts[0], "i").join(texts[1], "j").filter("i_block = j_block")
    return score_pairs(pairs, cutoff, scorer)


def candidate_pairs(
    df: DataFrame, cutoff: float = REVIEW, scorer: str = "token_set_ratio", whole: bool | None = None
) -> DataFrame:
    """All scored pairs of distinct names of a lead table, for review tools. Deduplication
    itself only forms pairs with leaders (``resolve_leaders``)."""
    classes = cut_lineage(with_keys(name_classes(df, scorer), cutoff, scorer, whole))
    return scored_pairs(classes, classes, cutoff, scorer)


#: So many pairs are walked in order by one task; more are settled in rounds.
ONE_WALK = 1 << 16


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Absorbed names of a few pairs (i, j): in order, a name that nobody took takes its later ones."""
    taken: set[int] = set()
    whole = pd.concat([pd.DataFrame({"i": [], "j": []}, dtype="int64"), *batches])
    for i, j in sorted(zip(whole["i"].tolist(), whole["j"].tolist(), strict=True)):
        if i not in taken:
            taken.add(j)
    yield pd.DataFrame({"rep": list(taken)}, dtype="int64")


def first_independent(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Leaders among ``nodes(rep)``: nodes without an earlier leader among their ``pairs(i, j)``.

    Each round, nodes with no remaining earlier neighbour are leaders and their later
    neighbours are absorbed; all pairs of either leave the graph. Every round shrinks it, and the
    written tables of a round are all the next one needs. What is small, or has become so, is
    walked by one task instead: a round is a dozen jobs, whose plans the driver holds.
    """
    open_pairs, absorbed = pairs.select("i", "j"), []
    while (left := open_pairs.count()) > ONE_WALK:
        waiting = open_pairs.select(F.col("j").alias("i")).distinct()
        taken = cut_lineage(open_pairs.join(waiting, "i", "left_anti").select(F.col("j").alias("rep")).distinct())
        absorbed.append(taken)
        open_pairs = cut_lineage(
            open_pairs.join(taken.withColumnRenamed("rep", "i"), "i", "left_anti")
            .join(taken.withColumnRenamed("rep", "j"), "j", "left_anti").select("i", "j")
        )
    if left:
        absorbed.append(open_pairs.repartition(1).mapInPandas(_walk, "rep bigint"))
    leaders = nodes.select("rep")
    return leaders.join(reduce(DataFrame.unionByName, absorbed), "rep", "left_anti") if absorbed else leaders


@dataclass
class Leaders:
    """``classes`` (block, tokens, rep, members, keys); ``leader_pairs`` (i, j, score):
    every pair of a leader i with a later name j not absorbed before i; ``leaders`` (rep)."""

    classes: DataFrame
    leader_pairs: DataFrame
    leaders: DataFrame


def resolve_leaders(
    df: DataFrame,
    auto: int = AUTO_MERGE,
    review: int = REVIEW,
    scorer: str = "token_set_ratio",
    first_batch: int = 500,
    growth: int = 8,
) -> Leaders:
    classes = cut_lineage(with_keys(name_classes(df, scorer), review, scorer))
    rest, batch_size = classes, first_batch
    remaining = rest.count()
    pairs, leaders = [], []
    while remaining:
        if remaining > batch_size:
            limit = rest.stat.approxQuantile("rep", [batch_size / remaining], 0.001)[0]
            batch = rest.filter(F.col("rep") <= limit)
            rest = rest.filter(F.col("rep") > limit)
        else:
            batch, rest = rest, None
        inside = cut_lineage(scored_pairs(batch, batch, review, scorer))
        won = cut_lineage(first_independent(inside.filter(F.col("score") >= auto), batch))
        is_leader = won.withColumnRenamed("rep", "i")
        leaders.append(won)
        pairs.append(cut_lineage(inside.join(is_leader, "i", "left_semi")))
        if rest is None:
            break
        across = cut_lineage(scored_pairs(batch.join(won, "rep", "left_semi"), rest, review, scorer))
        pairs.append(across)
        taken = across.filter(F.col("score") >= auto).select(F.col("j").alias("rep")).distinct()
        rest = cut_lineage(rest.join(taken, "rep", "left_anti"))
        remaining, batch_size = rest.count(), batch_size * growth
    if not leaders:
        spark = df.sparkSession
        return Leaders(classes, spark.createDataFrame([], "i bigint, j bigint, score int"),
                       classes.select("rep"))
    all_pairs, all_leaders = pairs[0], leaders[0]
    for more in pairs[1:]:
        all_pairs = all_pairs.unionByName(more)
    for more in leaders[1:]:
        all_leaders = all_leaders.unionByName(more)
    return Leaders(classes, all_pairs.select("i", "j", "score"), all_leaders)


def owners(found: Leaders, auto: int = AUTO_MERGE) -> DataFrame:
    """(rep, owner): absorbed classes with the smallest leader that takes them."""
    return found.leader_pairs.filter(F.col("score") >= auto).groupBy(F.col("j").alias("rep")) \
        .agg(F.min("i").alias("owner"))


def review_pairs(found: Leaders, auto: int = AUTO_MERGE) -> DataFrame:
    """(i, j, score) below ``auto`` that were compared while j was still alive."""
    own = owners(found, auto).withColumnRenamed("rep", "j")
    return found.leader_pairs.filter(F.col("score") < auto).join(own, "j", "left") \
        .filter(F.col("owner").isNull() | (F.col("owner") > F.col("i"))).select("i", "j", "score")


def record_owners(df: DataFrame, found: Leaders, auto: int = AUTO_MERGE, scorer: str = "token_set_ratio") -> DataFrame:
    """(ord, owner_ord) for every absorbed record, members of a class included."""
    name = F.col("company_name_normalized")
    by_class = found.classes.select("block", "tokens", "rep").join(owners(found, auto), "rep", "left")
    records = df.select("ord", block_key(name).alias("block"), comparison_tokens(name, scorer).alias("tokens"))
    return records.join(by_class, ["block", "tokens"]) \
        .withColumn("owner_ord", F.coalesce("owner", "rep")) \
        .filter("owner_ord <> ord").select("ord", "owner_ord")


def flag_reviews(df: DataFrame, found: Leaders, auto: int = AUTO_MERGE) -> DataFrame:
    """(ord, flagged_by): leaders that look like an earlier leader; the last one wins."""
    flagged = review_pairs(found, auto).groupBy(F.col("j").alias("ord")).agg(F.max("i").alias("flagged_by"))
    return flagged.join(found.leaders.withColumnRenamed("rep", "ord"), "ord", "left_semi")


def fuzzy_counters(found: Leaders, auto: int = AUTO_MERGE) -> DataFrame:
    """One row: fuzzy_auto_merged (records), fuzzy_flagged_review (pairs)."""
    none = F.lit(0).cast("bigint")
    records = found.classes.select(F.col("members").alias("merged"), none.alias("flagged"))
    leaders = found.leaders.select(F.lit(-1).cast("bigint").alias("merged"), none.alias("flagged"))
    members = found.classes.select(F.col("rep").alias("j"), "members")
    flagged = review_pairs(found, auto).join(members, "j").select(
        none.alias("merged"), F.col("members").alias("flagged"))
    return records.unionByName(leaders).unionByName(flagged).agg(
        F.coalesce(F.sum("merged"), none).alias("fuzzy_auto_merged"),
        F.coalesce(F.sum("flagged"), none).alias("fuzzy_flagged_review"),
    )


def dedup_fuzzy(
    df: DataFrame,
    auto: int = AUTO_MERGE,
    review: int = REVIEW,
    scorer: str = "token_set_ratio",
    size_col: str = "_absorbed",
    **batching: int,
) -> tuple[DataFrame, Leaders]:
    """Survivors with fields merged from what they absorbed, ``needs_review`` and
    ``is_duplicate_of`` set on flagged ones; plus the leader tables."""
    found = resolve_leaders(df, auto, review, scorer, **batching)
    owned = record_owners(df, found, auto, scorer)
    grouped = df.join(owned, "ord", "left").withColumn("_group", F.coalesce("owner_ord", "ord")).drop("owner_ord")
    merged = merge_groups(grouped, ["_group"], -F.col("ord"), size_col)
    ids = df.select(F.col("ord").alias("flagged_by"), F.col("pipeline_id").alias("_flag_id"))
    flags = flag_reviews(df, found, auto).join(ids, "flagged_by").select("ord", "_flag_id")
    out = merged.drop("needs_review", "is_duplicate_of").join(flags, "ord", "left").withColumns({
        "needs_review": F.col("_flag_id").isNotNull(), "is_duplicate_of": F.col("_flag_id"),
    }).drop("_flag_id")
    return out, found
