"""Line deduplication by site-relative frequency.

A line (between line feeds; spaces, tabs and carriage returns at its ends don't count) is
boilerplate on a host if it stands in at least ``least_pages`` of the host's pages and in more
than ``ratio`` of them. Pages are counted once for a line however often they repeat it.

Lines travel as 64-bit hashes: counting shuffles one number per host and distinct line of a
page, pre-aggregated. A host has at most (mean lines per page) / ``ratio`` boilerplate lines, so
they fit one row per host; that table is written, and its join to the pages is planned by its
size, with hot hosts split where it is not broadcast. Lines are then dropped within each row.

Defined results: lines without other characters than those trimmed are never counted or
dropped. NULL host is a host of its own. NULL text stays NULL; a text that loses every line is
empty. Repeated rows count as pages each. Other columns pass through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.llm.common import packed, unpacked, written

RATIO = 0.1
LEAST_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """_host, _lines: the hashes of the boilerplate lines of every host that has some."""
    pages = docs.select(F.col(host_col).alias("_host"), F.col(text_col).alias("_text"))
    distinct = F.array_distinct(F.transform(
        F.filter(_lines(F.col("_text")), lambda x: _trimmed(x) != ""), lambda x: F.xxhash64(_trimmed(x))))
    counted = (
        pages.select("_host", F.explode(distinct).alias("_line")).groupBy("_host", "_line")
        .agg(F.count(F.lit(1)).alias("_with")).filter(F.col("_with") >= least_pages))
    totals = written(pages.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages")), "host-pages").withColumnRenamed("_host", "_of")
    return (
        counted.join(totals, F.col("_host").eqNullSafe(F.col("_of")))
        .filter(F.col("_with") > F.lit(ratio) * F.col("_pages"))
        .groupBy("_host").agg(F.collect_set("_line").alias("_lines")))


def judged_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with boilerplate lines dropped from the text, and n_lines, n_dropped (long); columns
    of these two names are replaced."""
    new = {"n_lines", "n_dropped"}
    return _judged(docs, host_col, text_col, **limits).select(
        *unpacked([c for c in docs.columns if c not in new], {text_col: F.col("text")}), *sorted(new, reverse=True))


def _judged(docs: DataFrame, host_col: str, text_col: str, **limits) -> DataFrame:
    """given (the packed row), text without boilerplate lines, n_lines, n_dropped."""
    found = written(boilerplate(docs, host_col, text_col, **limits), "boilerplate")
    lines = _lines(F.col("old"))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("_lines"), F.xxhash64(_trimmed(x))) | (_trimmed(x) == ""))
    rows = docs.select(packed(docs).alias("given"), F.col(host_col).alias("host"), F.col(text_col).alias("old"))
    met = rows.join(found, F.col("host").eqNullSafe(F.col("_host")), "left")
    has = F.col("_lines").isNotNull() & F.col("old").isNotNull()
    return met.withColumn("kept", F.when(has, kept)).select(
        "given", F.when(has, F.array_join("kept", "\n")).otherwise(F.col("old")).alias("text"),
        F.when(F.col("old").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(has, F.size(lines) - F.size("kept")).otherwise(0).cast("long").alias("n_dropped"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` without boilerplate lines; the same rows and columns."""
    return _judged(docs, host_col, text_col, **limits).select(unpacked(docs.columns, {text_col: F.col("text")}))
