"""Directory descriptions: how a source is searched and where its fields sit on a page."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The five built-in directories.
BUILT_IN = [
    {
        "name": "bbb",
        "base_url": "https://www.bbb.org/search",
        "renderer": "static",
        "search_params": {"find_text": "{query}", "find_loc": "{location}"},
        "pagination": {"type": "url_param", "param": "page", "start": 1, "max_pages": 50},
        "listing_selector": "div.search-result-item",
        "selectors": {
            "company_name": "h3.result-name a::text",
            "phone": "span.result-phone::text",
            "address": "p.result-address::text",
            "rating": "span.result-rating::text",
            "category": "span.result-category::text",
            "website": "a.result-website::attr(href)",
        },
    },
    {
        "name": "clutch",
        "base_url": "https://clutch.co",
        "renderer": "static",
        "search_params": {},
        "url_template": "https://clutch.co/{category}?page={page}",
        "pagination": {"type": "url_param", "param": "page", "start": 1, "max_pages": 50},
        "listing_selector": "li.provider-row",
        "selectors": {
            "company_name": "h3.company_info a::text",
            "website": "a.company-website::attr(href)",
            "rating": "span.rating::text",
            "review_count": "span.reviews-count::text",
            "hourly_rate": "div.hourly-rate span::text",
            "min_project": "div.min-project span::text",
            "category": "div.company-specialties a::text",
            "address": "span.locality::text",
        },
    },
    {
        "name": "crunchbase",
        "base_url": "https://www.crunchbase.com/discover/organization.companies",
        "renderer": "playwright",
        "search_params": {"query": "{query}", "location": "{location}"},
        "pagination": {"type": "scroll", "start": 0, "max_pages": 20},
        "listing_selector": "div.component--grid-row",
        "app_state_selector": "script#ng-state",
        "app_state_path": "HttpState.GET.*.body.entities[]",
        "selectors": {
            "company_name": "a.component--field-formatter::text",
            "website": "a.component--field-formatter::attr(href)",
            "category": "span.identifier-label::text",
            "address": "span.location-card::text",
            "rating": None,
            "phone": None,
        },
    },
    {
        "name": "yellowpages",
        "base_url": "https://www.yellowpages.com/search",
        "renderer": "static",
        "search_params": {"search_terms": "{query}", "geo_location_terms": "{location}"},
        "pagination": {"type": "url_param", "param": "page", "start": 1, "max_pages": 50},
        "listing_selector": "div.result",
        "selectors": {
            "company_name": "a.business-name::text",
            "phone": "div.phones::text",
            "address": "div.adr::text",
            "website": "a.track-visit-website::attr(href)",
            "category": "div.categories a::text",
        },
    },
    {
        "name": "yelp",
        "base_url": "https://www.yelp.com/search",
        "renderer": "static",
        "search_params": {"find_desc": "{query}", "find_loc": "{location}"},
        "pagination": {"type": "offset", "param": "start", "start": 0, "step": 10, "max_pages": 100},
        "listing_selector": "[data-testid='serp-ia-card']",
        "selectors": {
            "company_name": "a.css-19v1rkv::text",
            "phone": "p.css-1p9ibgf::text",
            "address": "p.css-e81eai::text",
            "rating": "div[aria-label*='star rating']::attr(aria-label)",
            "review_count": "span.css-chan6m::text",
            "category": "p.css-gc9oho a::text",
        },
        "json_ld": {
            "name": "company_name",
            "telephone": "phone",
            "address.streetAddress": "address",
            "aggregateRating.ratingValue": "rating",
        },
    },
]

_PARAM = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
SEARCH_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("base_url", T.StringType()),
    T.StructField("url_template", T.StringType()), T.StructField("renderer", T.StringType()),
    T.StructField("search_params", T.ArrayType(_PARAM)),
    T.StructField("page_type", T.StringType()), T.StructField("page_param", T.StringType()),
    T.StructField("page_start", T.IntegerType()), T.StructField("page_step", T.IntegerType()),
    T.StructField("max_pages", T.IntegerType()),
])


def get_config(name: str, configs: list[dict] = BUILT_IN) -> dict:
    for config in configs:
        if config["name"] == name:
            return config
    raise ValueError(f"unknown source {name!r}; known: {sorted(c['name'] for c in configs)}")


def check_sources(df: DataFrame, configs: list[dict] = BUILT_IN) -> None:
    """Rows of a source without a description are an error, not left out."""
    known = [c["name"] for c in configs]
    strange = df.filter(~F.coalesce(F.col("source").isin(*known), F.lit(False))).select("source").limit(1).collect()
    if strange:
        get_config(strange[0][0], configs)


def search_configs(spark: SparkSession, configs: list[dict] = BUILT_IN) -> DataFrame:
    """The search side of the descriptions as a small table (one row per source)."""
    rows = []
    for c in configs:
        page = c["pagination"]
        params = list(c.get("search_params", {}).items())
        rows.append((c["name"], c.get("base_url", ""), c.get("url_template"), c["renderer"], params,
                     page["type"], page.get("param"), page.get("start", 0), page.get("step", 1),
                     page.get("max_pages", 10)))
    return spark.createDataFrame(rows, SEARCH_SCHEMA)
