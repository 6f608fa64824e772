"""Stored directory pages: request frontier, lookup, upsert, purge. A snapshot table is keyed
by (source, slug of query, slug of location, page) and best stored partitioned by source."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.functions.text import slug
from leadweave.functions.urls import fill_template, form_encode
from leadweave.operators.key_filter import key_filter

KEY = ["source", "slug_query", "slug_location", "page"]


def _page_key() -> Column:
    return F.struct(*KEY)


def page_value(page: Column) -> Column:
    """Page number as the source counts: from ``start``, in steps for offset paging."""
    return (
        F.when(F.col("page_type") == "url_param", F.col("page_start") + page)
        .when(F.col("page_type") == "offset", F.col("page_start") + page * F.col("page_step"))
        .otherwise(page)
    )


def build_url() -> Column:
    """Address of one result page, from a request joined with its search configuration."""
    number = page_value(F.col("page")).cast("string")
    query, location = form_encode(F.col("query")), form_encode(F.col("location"))
    from_template = fill_template(
        F.col("url_template"), category=query, page=number, query=query, location=location)
    filled = F.transform("search_params", lambda p: F.struct(
        p["key"].alias("key"),
        fill_template(p["value"], query=F.col("query"), location=F.col("location")).alias("value"),
    ))
    paged = F.col("page_type").isin("url_param", "offset")
    params = F.when(paged, F.concat(
        F.filter(filled, lambda p: p["key"] != F.col("page_param")),
        F.array(F.struct(F.col("page_param").alias("key"), number.alias("value"))),
    )).otherwise(filled)
    text = F.array_join(F.transform(
        params, lambda p: F.concat(form_encode(p["key"]), F.lit("="), form_encode(p["value"]))), "&")
    bare = (F.col("renderer") == "playwright") & (F.size("search_params") == 0)
    from_params = F.when(bare, F.col("base_url")).otherwise(
        F.concat("base_url", F.lit("?"), text))
    return F.when(F.coalesce(F.col("url_template"), F.lit("")) != "", from_template).otherwise(from_params)


def build_frontier(requests: DataFrame, configs: DataFrame) -> DataFrame:
    """One row per (source, query, location, page) with its URL. Scrolled sources have a
    single address. Requests of sources without a description have no rows: refuse them first
    with ``configs.check_sources``. The configuration table has a row per source; its size is
    known to the planner, which joins it without a shuffle."""
    last = F.when(F.col("page_type") == "scroll", 0).otherwise(F.col("max_pages") - 1)
    return (
        requests.join(configs, "source")
        .withColumn("page", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("url", build_url())
        .select("source", "query", "location", "page", "url")
    )


def with_page_key(requests: DataFrame) -> DataFrame:
    return requests.withColumns({
        "slug_query": slug(F.col("query")), "slug_location": slug(F.col("location")),
    })


def lookup_pages(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Requests with the stored ``html``; NULL where nothing is stored. Only pages whose key may
    be among the requests leave the place where they are stored."""
    asked = with_page_key(requests)
    stored = snapshots.filter(key_filter(asked, _page_key())(_page_key())).select(*KEY, "html")
    return asked.join(stored, KEY, "left").select(*requests.columns, "html")


def has_page(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Only the requests whose page is stored."""
    return with_page_key(requests).join(snapshots.select(KEY), KEY, "left_semi").select(requests.columns)


def upsert_pages(snapshots: DataFrame, new_pages: DataFrame) -> DataFrame:
    """Last write per key wins. Snapshots whose key is none of the new ones, by a Bloom filter,
    stay where they are; the few it can't tell are checked against the new keys."""
    touched = key_filter(new_pages, _page_key())(_page_key())
    kept = snapshots.filter(touched).join(new_pages.select(KEY).distinct(), KEY, "left_anti")
    return snapshots.filter(~touched).select(snapshots.columns).unionByName(kept.select(snapshots.columns)) \
        .unionByName(latest_pages(new_pages, snapshots.columns))


def latest_pages(new_pages: DataFrame, columns: list[str]) -> DataFrame:
    """The last fetched row of every key."""
    rest = [c for c in columns if c not in KEY]
    return new_pages.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "fetched_at").alias("_p")) \
        .select(*[c if c in KEY else F.col(f"_p.{c}").alias(c) for c in columns])


def purge_pages(snapshots: DataFrame, source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one-row count of dropped ones) for one source or for all."""
    doomed = F.lit(True) if source is None else F.coalesce(F.col("source") == source, F.lit(False))
    return snapshots.filter(~doomed), snapshots.filter(doomed).agg(F.count(F.lit(1)).alias("purged"))
