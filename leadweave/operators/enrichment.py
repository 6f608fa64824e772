"""Stage ``enricher``: leads joined with a snapshot of crawled company sites.

``site_pages(url, path, status_head, status_get, html)`` holds, per website, the home page
(path ``''``) and the contact paths. Pages of sites that no lead names are dropped by a Bloom
filter where they are read; the others are reduced to what they say, then to one small row per
site, and only that is joined: page bodies are never shuffled.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.functions.urls import is_safe_url
from leadweave.operators.key_filter import key_filter
from leadweave.session import salted_join

# Where to look, what an address looks like, and which addresses to pass over.
CONTACT_PATHS = ("/contact", "/about", "/contact-us")
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
GENERIC_PREFIXES = (
    "info@", "support@", "sales@", "webmaster@", "admin@",
    "noreply@", "no-reply@", "donotreply@", "example@",
)
FOREIGN_DOMAINS = ("googleapis.com", "cloudflare.com", "sentry.io", "example.com")
SOCIAL_PATTERNS = {
    "linkedin": r"""https?://(?:www\.)?linkedin\.com/company/[^\s"'<>]+""",
    "facebook": r"""https?://(?:www\.)?facebook\.com/[^\s"'<>]+""",
    "twitter": r"""https?://(?:www\.)?(?:twitter\.com|x\.com)/[^\s"'<>]+""",
}


def site_key(col: Column) -> Column:
    """Sites are matched without trailing slashes, the way contact paths are appended."""
    return F.regexp_replace(col, "/+$", "")


def is_alive(status_head: Column, status_get: Column) -> Column:
    """HEAD in 200..299; where HEAD is not allowed (405) the GET status decides; no answer is
    not alive."""
    answer = F.when(status_head == 405, status_get).otherwise(status_head)
    return F.coalesce(answer.between(200, 299), F.lit(False))


def first_contact_email(html: Column) -> Column:
    """First address in a page that is neither a generic mailbox nor of a service domain."""
    def usable(address):
        low = F.lower(address)
        bad = F.lit(False)
        for prefix in GENERIC_PREFIXES:
            bad = bad | low.startswith(prefix)
        for domain in FOREIGN_DOMAINS:
            bad = bad | low.endswith(domain)
        return ~bad
    found = F.filter(F.regexp_extract_all(html, F.lit(EMAIL_PATTERN), F.lit(0)), usable)
    return F.get(found, F.lit(0))


def social_map(html: Column) -> Column:
    """platform -> first matching link, or NULL when there is none."""
    entries = [F.lit(x) if i == 0 else x
               for name, pattern in SOCIAL_PATTERNS.items()
               for i, x in enumerate((name, F.regexp_extract(html, pattern, 0)))]
    links = F.map_filter(F.create_map(*entries), lambda _, link: link != "")
    return F.when(F.size(links) > 0, links)


def site_facts(site_pages: DataFrame, wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per site: alive, contact_email, social_links; of sites whose key passes ``wanted``."""
    home, ok = F.col("path") == "", F.col("status_get") == 200
    rank = F.array_position(F.array(*[F.lit(p) for p in CONTACT_PATHS]), F.col("path"))
    asked = home | (rank > 0)
    if wanted:
        asked = asked & wanted(site_key(F.col("url")))
    reduced = site_pages.filter(asked).select(
        site_key(F.col("url")).alias("site"),
        F.when(home, is_alive(F.col("status_head"), F.col("status_get"))).alias("alive"),
        F.when(~home & ok, first_contact_email(F.col("html"))).alias("email"),
        rank.alias("rank"),
        F.col("url"),
        F.when(home & ok, social_map(F.col("html"))).alias("social"),
    )
    return reduced.groupBy("site").agg(
        F.coalesce(F.bool_or("alive"), F.lit(False)).alias("_alive"),
        F.expr("min_by(email, rank) FILTER (WHERE email IS NOT NULL)").alias("_email"),
        F.expr("min_by(social, url) FILTER (WHERE social IS NOT NULL)").alias("_social"),
    )


def enrich(df: DataFrame, site_pages: DataFrame) -> DataFrame:
    """Add ``website_alive`` (NULL without a safe website), ``social_links``, and fill a
    missing ``email`` from the contact pages of live sites."""
    safe = F.coalesce((F.col("website") != "") & is_safe_url(F.col("website")), F.lit(False))
    site = F.when(safe, site_key(F.col("website")))
    facts = site_facts(site_pages, key_filter(df, site)).withColumnRenamed("site", "_site")
    joined = salted_join(df.withColumn("_site", site), facts, "_site").withColumn(
        "website_alive", F.when(F.col("_site").isNotNull(), F.coalesce("_alive", F.lit(False))))
    alive = F.coalesce("website_alive", F.lit(False))
    found = alive & F.coalesce(F.col("email") == "", F.lit(True)) & F.col("_email").isNotNull()
    return joined.withColumns({
        "email": F.when(found, F.col("_email")).otherwise(F.col("email")),
        "social_links": F.when(alive, F.col("_social")),
    }).select(*df.columns, "website_alive", "social_links")


def enrich_counters(before: str = "_before") -> list[Column]:
    """Counters over enriched rows that carry their input row in the struct ``before``."""
    def count(condition, name):
        return F.count_if(condition).cast("bigint").alias(name)

    had = F.coalesce(F.col(f"{before}.email") != "", F.lit(False))
    return [
        count(F.col("website_alive").isNotNull(), "websites_checked"),
        count(F.col("website_alive"), "websites_alive"),
        count(~had & F.coalesce(F.col("email") != "", F.lit(False)), "emails_found"),
        count(F.col("social_links").isNotNull(), "social_links_found"),
    ]


def enrich_stats(df: DataFrame, site_pages: DataFrame) -> DataFrame:
    snapshot = df.withColumn("_before", F.struct("email"))
    return enrich(snapshot, site_pages).agg(*enrich_counters())
