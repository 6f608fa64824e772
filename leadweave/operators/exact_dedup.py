"""Exact deduplication: groups of equal keys, one survivor each, missing fields filled."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.session import salted_join

# Columns that describe the survivor itself and are never filled from another row.
_OWN = {"ord", "pipeline_id", "is_duplicate_of", "needs_review"}


def non_null_fields(df: DataFrame) -> Column:
    """How many fields of a row are filled; an empty string counts as filled."""
    fields = [c for c in df.columns if not c.startswith("_")]
    return sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0))


def _is_own(name: str) -> bool:
    return name.startswith("_") or name in _OWN


def merge_groups(
    df: DataFrame, keys: list[str], survivor_rank: Column, size_col: str, whole: bool = False
) -> DataFrame:
    """One row per group: the row with the greatest ``survivor_rank``, its NULLs filled by the
    first non-null value in ``ord`` order, and the longest company name of the group.

    Only aggregates, so a group of any size is folded on the map side first and never sits in
    one task. ``size_col`` receives the number of absorbed rows. ``whole``: all columns are folded,
    whichever are read later, so that several readers share one aggregate.
    """
    fields = [c for c in df.columns if c not in keys]
    fill = [c for c in fields if not _is_own(c)]
    aggs = [F.max_by(F.struct(*fields), survivor_rank).alias("_s"),
            F.count(F.lit(1)).alias("_size")]
    aggs += [
        F.expr(f"min_by(`{c}`, ord) FILTER (WHERE `{c}` IS NOT NULL)").alias(f"_fill_{c}")
        for c in fill if c != "company_name"
    ]
    longest = F.max_by("company_name", F.struct(F.length("company_name"), -F.col("ord")))
    folded = df.groupBy(*keys).agg(*aggs, longest.alias("_longest"))
    if whole:
        # holds for every row. It names what was folded, not the columns made of it below: of those,
        # Spark would derive a condition for every subset when the result is written (2^columns)
        held = [c for c in folded.columns if c not in keys]
        folded = folded.filter(sum((F.col(c).isNotNull().cast("int") for c in held), F.lit(0)) >= 0)

    def final(name):
        own = F.col(f"_s.`{name}`")
        if name == "company_name":
            longer = F.length("_longest") > F.coalesce(F.length(own), F.lit(-1))
            return F.when(longer, F.col("_longest")).otherwise(own).alias(name)
        if _is_own(name):
            return own.alias(name)
        return F.coalesce(own, F.col(f"_fill_{name}")).alias(name)

    return folded.select(
        *[final(c) for c in fields], (F.col("_size") - 1).alias(size_col)
    )


def _key(column: str, exclude: list[str] | None) -> Column:
    value = F.nullif(F.col(column), F.lit(""))
    if exclude:
        value = F.when(~F.lower(value).isin([e.lower() for e in exclude]), value)
    return value


def dedup_exact(
    df: DataFrame, key: str, size_col: str = "_absorbed", exclude: list[str] | None = None, whole: bool = False
) -> DataFrame:
    """Collapse rows sharing a non-empty ``key``; the most complete row survives, the first
    in ``ord`` order on ties. Rows without a key pass by, neither grouped nor shuffled.
    ``exclude`` lists key values (for instance generic mailboxes) that never link rows;
    ``whole`` as in ``merge_groups``."""
    rank = F.struct(non_null_fields(df).alias("n"), (-F.col("ord")).alias("o"))
    keyed = df.withColumn("_key", _key(key, exclude))
    merged = merge_groups(keyed.filter("_key IS NOT NULL"), ["_key"], rank, size_col, whole)
    alone = keyed.filter("_key IS NULL").withColumn(size_col, F.lit(0).cast("bigint"))
    return merged.select(*df.columns, size_col).unionByName(alone.select(*df.columns, size_col))


def duplicate_map(df: DataFrame, key: str, exclude: list[str] | None = None) -> DataFrame:
    """(removed_id, survivor_id) of one exact pass. Only ids and the key are shuffled."""
    slim = df.select(
        _key(key, exclude).alias("_key"), "pipeline_id", "ord",
        non_null_fields(df).alias("_n"),
    ).filter("_key IS NOT NULL")
    survivors = slim.groupBy("_key").agg(
        F.max_by("pipeline_id", F.struct("_n", -F.col("ord"))).alias("survivor_id"),
        F.count(F.lit(1)).alias("_size"),
    ).filter("_size > 1")
    return salted_join(slim, survivors, "_key", "inner").filter("pipeline_id <> survivor_id").select(
        F.col("pipeline_id").alias("removed_id"), "survivor_id"
    )


def last_survivors(*passes: DataFrame) -> DataFrame:
    """(removed_id, survivor_id) of several passes in a row, each a map of its own: what an earlier
    pass kept and a later one removed is followed to the end. Only ids are shuffled; a survivor
    that many rows point to is spread over partitions."""
    whole = passes[0]
    for later in passes[1:]:
        onward = later.select(F.col("removed_id").alias("survivor_id"), F.col("survivor_id").alias("_next"))
        moved = salted_join(whole, onward, "survivor_id").select(
            "removed_id", F.coalesce("_next", "survivor_id").alias("survivor_id"))
        whole = moved.unionByName(later.select("removed_id", "survivor_id"))
    return whole
