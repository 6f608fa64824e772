"""Stored pages to lead rows. ``pages(page_id, source, url, html)`` in, one row per listing
out. Reading the HTML is a per-page helper; merging, fallback and admission are relational."""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadweave.functions import html as H
from leadweave.functions.text import unescape_html
from leadweave.sources.configs import BUILT_IN

LISTING_SCHEMA = "page_id bigint, source string, url string, idx int, fields map<string,string>"
_LD_SCRIPT = r"""(?is)<script[^>]*type\s*=\s*['"]?application/ld\+json['"]?[^>]*>(.*?)</script>"""


_LISTING = "(listing)"


def _selectors(configs: list[dict]) -> dict[str, dict[str, str]]:
    """Per source the selectors of its description, that of its listings among them."""
    return {c["name"]: {_LISTING: c["listing_selector"], **{k: v for k, v in c["selectors"].items() if v}} for c in configs}


def extract_listings(pages: DataFrame, configs: list[dict] = BUILT_IN) -> DataFrame:
    """(page_id, source, url, idx, fields): each container matched by the listing selector of
    the page's source, with the first match of every field selector, stripped. Containers
    without any field keep their place, so positions line up with JSON-LD objects."""
    rules = _selectors(configs)

    def read(batches):
        programs = {source: H.Program(of, _LISTING) for source, of in rules.items()}
        for batch in batches:
            rows = []
            for page_id, source, url, text in zip(batch.page_id, batch.source, batch.url, batch.html):
                if source not in rules or text is None:
                    continue
                for idx, found in enumerate(H.PageScan.of(programs[source], text).boxes):
                    fields = {name: value.strip() for name, value in found.items() if value}
                    rows.append((page_id, source, url, idx, fields))
            yield pd.DataFrame(rows, columns=["page_id", "source", "url", "idx", "fields"])

    return pages.select("page_id", "source", "url", "html").mapInPandas(read, LISTING_SCHEMA)


def _ld_objects(html: Column) -> Column:
    """Every JSON-LD object of a page as text, in order; unreadable scripts are skipped."""
    def objects(script):
        text = F.trim(script)
        return F.when(F.try_parse_json(text).isNull(), F.array().cast("array<string>")).when(
            text.startswith("["), F.from_json(text, "array<string>")
        ).when(text.startswith("{"), F.array(text)).otherwise(F.array().cast("array<string>"))

    scripts = F.regexp_extract_all(html, F.lit(_LD_SCRIPT), F.lit(1))
    return F.flatten(F.transform(scripts, objects))


def json_path(text: Column, dotted: str) -> Column:
    """Value at a dotted path as text, NULL when any step is missing."""
    return F.try_variant_get(F.try_parse_json(text), "$." + dotted, "string")


def extract_json_ld(pages: DataFrame, configs: list[dict] = BUILT_IN) -> DataFrame:
    """(page_id, source, url, idx, fields) of the JSON-LD objects, for sources that map any."""
    mapped = {c["name"]: c["json_ld"] for c in configs if c.get("json_ld")}
    out = pages.filter(F.col("source").isin(*mapped)).select(
        "page_id", "source", "url", F.posexplode(_ld_objects(F.col("html"))).alias("idx", "ld"))
    fields = F.lit(None)
    for name, paths in mapped.items():
        entries = [x for path, field in paths.items()
                   for x in (F.lit(field), json_path(F.col("ld"), path))]
        fields = F.when(F.col("source") == name, F.create_map(*entries)).otherwise(fields)
    return out.withColumn("fields", F.map_filter(fields, lambda _, v: v.isNotNull())).drop("ld")


def merge_by_position(listings: DataFrame, json_ld: DataFrame) -> DataFrame:
    """The i-th JSON-LD object overrides the fields of the i-th container; empty values do
    not. Objects beyond the last container are not used."""
    ld = json_ld.select("page_id", "idx", F.map_filter("fields", lambda _, v: v != "").alias("_ld"))
    empty = F.create_map().cast("map<string,string>")
    own = F.map_filter("fields", lambda k, _: ~F.coalesce(F.map_contains_key("_ld", k), F.lit(False)))
    return listings.join(ld, ["page_id", "idx"], "left").withColumn(
        "fields", F.map_concat(own, F.coalesce("_ld", empty))
    ).select(listings.columns)


def _path_steps(path: str) -> list[str]:
    """``a.b.*.c[]`` -> ["a", "b", "*", "c", "[]"]; ``[*]`` is read as ``[]``."""
    return re.findall(r"\[\*?\]|[^.\[\]]+", path)


def json_search(text: Column, path: str) -> Column:
    """All values a wildcard path reaches, as an array of JSON texts: ``*`` takes every value
    of an object, ``[]`` every element of a list."""
    none = F.array().cast("array<string>")

    def into(step):
        if step == "*":
            return lambda t: F.coalesce(F.map_values(F.from_json(t, "map<string,string>")), none)
        if step.startswith("["):
            return lambda t: F.coalesce(F.from_json(t, "array<string>"), none)
        return lambda t: F.array(F.get_json_object(t, f"$['{step}']"))

    found = F.array(text)
    for step in _path_steps(path):
        found = F.flatten(F.transform(F.filter(found, lambda t: t.isNotNull()), into(step)))
    return F.filter(found, lambda t: t.isNotNull())


def _script_text(html: Column, selector: str) -> Column:
    script_id = selector.partition("#")[2]
    mark = rf"""\bid\s*=\s*['"]?{re.escape(script_id)}['"]?[^>]*""" if script_id else ""
    return F.regexp_extract(html, rf"(?is)<script[^>]*{mark}>(.*?)</script>", 1)


def extract_app_state(pages: DataFrame, configs: list[dict] = BUILT_IN) -> DataFrame:
    """Listings embedded as application state: the script text is entity-decoded, searched by
    path, and each entity mapped with its fallbacks. Unreadable state gives no rows."""
    out = None
    for c in configs:
        if not c.get("app_state_selector"):
            continue
        state = unescape_html(_script_text(F.col("html"), c["app_state_selector"]))
        rows = pages.filter(F.col("source") == c["name"]).withColumn("_state", state).filter(
            F.try_parse_json("_state").isNotNull()
        ).select("page_id", "source", "url", F.posexplode(
            json_search(F.col("_state"), c.get("app_state_path") or "[]")).alias("idx", "_e"))
        out = rows if out is None else out.unionByName(rows)

    def value(path):
        return F.nullif(F.get_json_object("_e", path), F.lit(""))

    def listed(name):
        raw = value(f"$.{name}")
        return F.when(raw.startswith("["), F.array_join(F.from_json(raw, "array<string>"), ", ")).otherwise(raw)

    name = F.coalesce(value("$.name"), value("$.identifier.value"))
    located = value("$.location_identifiers").isNotNull() & (value("$.location_identifiers") != "[]")
    fields = {
        "company_name": name,
        "website": F.coalesce(value("$.website_url"), F.get_json_object("_e", "$.homepage_url")),
        "category": F.coalesce(
            F.when(value("$.category_groups_list") != "[]", listed("category_groups_list")),
            listed("categories")),
        "address": F.when(located, F.get_json_object("_e", "$.location_identifiers[0].value"))
        .otherwise(F.coalesce(F.get_json_object("_e", "$.headquarters"), F.lit(""))),
    }
    entries = [x for k, v in fields.items() for x in (F.lit(k), v)]
    return out.filter(name.isNotNull()).select(
        "page_id", "source", "url", "idx",
        F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull()).alias("fields"))


def prefer_app_state(app_state: DataFrame, listings: DataFrame) -> DataFrame:
    """App-state rows where a page has any, its listing rows otherwise."""
    rest = listings.join(app_state.select("page_id").distinct(), "page_id", "left_anti")
    return app_state.unionByName(rest.select(app_state.columns))


# Fields of a lead row that come straight from a listing.
LEAD_FIELDS = ["company_name", "phone", "email", "website", "address", "city", "state",
               "category", "rating", "review_count"]


def admit_listings(listings: DataFrame, scraped_at: Column | None = None) -> DataFrame:
    """Listings with a ``company_name`` or ``name`` as lead rows; other fields go to
    ``extras``."""
    named = F.col("fields")["company_name"]
    alias = F.col("fields")["name"]
    used_alias = ~F.map_contains_key("fields", F.lit("company_name"))
    company = F.when(used_alias, alias).otherwise(named)
    admitted = listings.filter((F.coalesce(named, F.lit("")) != "") | (F.coalesce(alias, F.lit("")) != ""))
    plain = [F.col("fields")[f].alias(f) for f in LEAD_FIELDS[1:]]
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss") if scraped_at is None else scraped_at
    return admitted.select(
        "page_id", "idx", company.alias("company_name"), *plain,
        F.map_filter("fields", lambda k, _: ~k.isin(*LEAD_FIELDS) & ~((k == "name") & used_alias)).alias("extras"),
        "source", F.col("url").alias("source_url"), now.alias("scraped_at"),
    )


def extract_pages(
    pages: DataFrame, configs: list[dict] = BUILT_IN, scraped_at: Column | None = None
) -> DataFrame:
    """All pages of all sources to lead rows: static pages merge listings with JSON-LD,
    rendered ones prefer their application state."""
    rendered = [c["name"] for c in configs if c["renderer"] == "playwright"]
    listings = extract_listings(pages, configs)
    static = merge_by_position(
        listings.filter(~F.col("source").isin(*rendered)), extract_json_ld(pages, configs))
    dynamic = prefer_app_state(
        extract_app_state(pages, configs), listings.filter(F.col("source").isin(*rendered)))
    return admit_listings(static.unionByName(dynamic.select(static.columns)), scraped_at)


def selector_coverage(pages: DataFrame, configs: list[dict] = BUILT_IN) -> DataFrame:
    """Per source and selector: pages read, matches over whole pages, whether it found nothing.
    The listing selector is reported under the field name ``(listing)``."""
    rules = _selectors(configs)

    def count(batches):
        programs = {source: H.Program(of) for source, of in rules.items()}
        for batch in batches:
            rows = []
            for source, text in zip(batch.source, batch.html):
                if source not in rules or text is None:
                    continue
                counts = H.PageScan.of(programs[source], text).counts
                rows += [(source, field, css, n) for (field, css), n in zip(rules[source].items(), counts)]
            yield pd.DataFrame(rows, columns=["source", "field", "selector", "n"])

    counted = pages.select("source", "html").mapInPandas(
        count, "source string, field string, selector string, n bigint")
    return counted.groupBy("source", "field", "selector").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("n").alias("matches")
    ).withColumn("missing", F.col("matches") == 0)


def sample_listings(listings: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` listings of each source, as a report shows them. Spark applies the rank
    limit on the map side, so at most ``n`` rows per source and partition are shuffled."""
    place = Window.partitionBy("source").orderBy("page_id", "idx")
    return listings.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= n) \
        .select("source", "rank", "page_id", "idx", "fields")
