"""Stop rule, item limit and summary of crawls whose pages are already stored."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadweave.session import salted_join

_BUCKET = 1024


def running_before(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over earlier rows of the group, by an integer ``order`` column that is
    unique in the group. Two levels: inside ranges of 1024 positions, then over the sums of
    ranges, so that a crawl of any length is spread over many tasks."""
    ranged = df.withColumn("_range", F.floor(F.col(order) / _BUCKET))
    inner = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum")) \
        .withColumn("_base", F.coalesce(F.sum("_sum").over(outer), F.lit(0))).drop("_sum")
    return ranged.join(sums, [*keys, "_range"]).withColumn(
        out, F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0))
    ).drop("_range", "_base")


def visited_pages(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Pages a crawl gets to, in page order: up to and with the first page read without items,
    and no further once ``limit`` items are there. ``pages(crawl, page, fetched, n_items)``;
    a page that could not be fetched is passed over and does not stop the crawl."""
    empty = pages.filter(F.col("fetched") & (F.col("n_items") == 0)) \
        .groupBy("crawl").agg(F.min("page").alias("_stop"))
    items = pages.withColumn("n_items", F.when(F.col("fetched"), F.col("n_items")).otherwise(0))
    seen = salted_join(running_before(items, ["crawl"], "page", "n_items", "items_before"), empty, "crawl") \
        .filter(F.col("_stop").isNull() | (F.col("page") <= F.col("_stop"))).drop("_stop")
    return seen if limit is None else seen.filter(F.col("items_before") < limit)


def limited_items(items: DataFrame, visited: DataFrame, limit: int | None = None) -> DataFrame:
    """Items of visited pages, cut to the limit; ``items(crawl, page, idx, ...)`` with ``idx``
    counting from 0 on each page."""
    kept = items.join(visited.select("crawl", "page", "items_before"), ["crawl", "page"])
    if limit is not None:
        kept = kept.filter(F.col("items_before") + F.col("idx") < limit)
    return kept.select(items.columns)


def crawl_summary(visited: DataFrame, limit: int | None = None) -> DataFrame:
    """pages_scraped, pages_skipped and items per crawl."""
    total = F.sum("n_items")
    return visited.groupBy("crawl").agg(
        F.count_if("fetched").alias("pages_scraped"),
        F.count_if(~F.col("fetched")).alias("pages_skipped"),
        (total if limit is None else F.least(total, F.lit(limit))).alias("items"),
    )
