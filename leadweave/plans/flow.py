"""From stored result pages to saved companies, as one flow."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadweave.operators.crawl import crawl_summary, limited_items, visited_pages
from leadweave.operators.extraction import extract_pages
from leadweave.plans.pipeline import PipelineRun, process_batch
from leadweave.session import cut_lineage
from leadweave.sources.leads import save_companies, to_companies


@dataclass
class Flow:
    """``summary``: pages_scraped, pages_skipped, items per crawl; ``run``: the chain's leads and
    stage rows."""

    summary: DataFrame
    run: PipelineRun


def listed_items(pages: DataFrame, scraped_at: Column | None = None) -> DataFrame:
    """Admitted listings of pages that were read, with their place ``idx`` on the page from 0.
    ``pages(crawl, page, source, page_id, url, html)``; the html of a page that could not be
    fetched is NULL."""
    found = extract_pages(pages.filter(F.col("html").isNotNull()), scraped_at=scraped_at)
    on_page = Window.partitionBy("source", "page_id").orderBy("idx")
    places = pages.select("source", "page_id", "crawl", "page")
    return found.withColumn("idx", (F.row_number().over(on_page) - 1).cast("bigint")).join(places, ["source", "page_id"])


def counted_pages(pages: DataFrame, items: DataFrame) -> DataFrame:
    """crawl, page, fetched, n_items: what the stop rule looks at, from the listings themselves."""
    counts = items.groupBy("crawl", "page").agg(F.count(F.lit(1)).alias("n_items"))
    return pages.select("crawl", "page", F.col("html").isNotNull().alias("fetched")).join(counts, ["crawl", "page"], "left") \
        .withColumn("n_items", F.coalesce("n_items", F.lit(0)))


def pages_to_companies(
    pages: DataFrame, order: Column, task_id: str, path: str, limit: int | None = None, scraped_at: Column | None = None, **chain,
) -> Flow:
    """Extract, apply the stop rule and the limit of every crawl, run the chain, save its
    companies under ``path`` as those of the task. ``order`` numbers the listings (source,
    page_id, idx) as the chain is to take them."""
    items = cut_lineage(listed_items(pages, scraped_at).withColumn("ord", order))
    visited = cut_lineage(visited_pages(counted_pages(pages, items), limit))
    raw = limited_items(items, visited, limit)
    run = process_batch(raw.drop("crawl", "page", "extras"), ["source", "source_url", "idx"], "ord", **chain)
    save_companies(to_companies(run.leads, task_id), path)
    return Flow(crawl_summary(visited, limit), run)
