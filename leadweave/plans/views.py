"""Lead-shaped views over the star-schema tables, written in SQL that Spark and DuckDB read
alike, so that a query and its oracle start from identical rows. ``raw_leads`` has one row
per order; customers repeat, so phone and e-mail duplicates occur naturally."""

import re

from pyspark.sql import DataFrame, SparkSession

from leadweave.plans.pipeline import prepare
from leadweave.session import compiled_rules, dealt, stored_table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

RAW_LEADS = """
SELECT CAST(o.o_orderkey AS BIGINT) AS lead_id,
  CASE WHEN o.o_orderkey % 97 = 0 THEN NULL
       ELSE concat(CASE WHEN o.o_orderkey % 11 = 0 THEN 'the ' ELSE '' END, p.p_name,
         CASE o.o_orderkey % 9 WHEN 0 THEN ' &amp; sons' WHEN 1 THEN '  plumbing' WHEN 2 THEN ' services' ELSE '' END,
         ' ', n.n_name,
         CASE o.o_orderkey % 6 WHEN 0 THEN ' LLC' WHEN 1 THEN ', Inc.' WHEN 2 THEN ' Corp.' WHEN 3 THEN ' Co' ELSE '' END) END AS company_name,
  CASE WHEN o.o_orderkey % 13 = 0 THEN NULL WHEN o.o_orderkey % 17 = 0 THEN '12345' ELSE
    CASE o.o_orderkey % 4
      WHEN 0 THEN concat('(', a.area, ') ', a.pre, '-', a.line)
      WHEN 1 THEN concat(a.area, '-', a.pre, '-', a.line)
      WHEN 2 THEN concat('+1', a.area, a.pre, a.line)
      ELSE concat(a.area, a.pre, a.line) END END AS phone,
  CASE WHEN o.o_orderkey % 10 = 3 THEN NULL WHEN o.o_orderkey % 19 = 0 THEN concat('contact', CAST(c.c_custkey AS STRING), '.example.com')
       ELSE concat('Contact', CAST(c.c_custkey % 1200 AS STRING), '@MAIL', CAST(c.c_custkey % 7 AS STRING), '.example.com') END AS email,
  CASE o.o_orderkey % 5 WHEN 0 THEN NULL
       WHEN 1 THEN concat('www.Shop', CAST(c.c_custkey AS STRING), '.example.org/')
       WHEN 2 THEN concat('https://shop', CAST(c.c_custkey AS STRING), '.example.org/p/?utm_source=x&id=', CAST(o.o_orderkey % 3 AS STRING), '#top')
       ELSE concat('http://shop', CAST(c.c_custkey AS STRING), '.example.org/a/b/') END AS website,
  concat(CAST(o.o_orderkey % 900 AS STRING), ' Main', CASE o.o_orderkey % 4 WHEN 0 THEN ' St' WHEN 1 THEN ' Ave, Ste 4' WHEN 2 THEN ' blvd' ELSE '{zwsp}' END) AS address,
  n.n_name AS city, r.r_name AS state, c.c_mktsegment AS category,
  CASE WHEN o.o_orderkey % 8 = 0 THEN 'A+' ELSE CAST(CAST(1 + o.o_orderkey % 5 AS INT) AS STRING) END AS rating,
  CAST(o.o_orderkey % 500 AS INT) AS review_count,
  CASE o.o_orderkey % 3 WHEN 0 THEN 'yellowpages' WHEN 1 THEN 'yelp' ELSE 'bbb' END AS source,
  concat('https://directory.example.org/', CAST(o.o_orderkey AS STRING)) AS source_url,
  CASE WHEN o.o_orderkey % 23 = 0 THEN 'yesterday' ELSE concat(CAST(CAST(o.o_orderdate AS DATE) AS STRING), 'T08:30:00') END AS scraped_at
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN part p ON p.p_partkey = c.c_custkey
JOIN (SELECT c_custkey AS k, CAST(201 + c_custkey % 700 AS STRING) AS area, CAST(200 + (c_custkey * 7) % 800 AS STRING) AS pre,
             CAST(1000 + (c_custkey * 13) % 9000 AS STRING) AS line FROM customer) a ON a.k = c.c_custkey
""".replace("{zwsp}", "\u200b")

# One crawl task per customer with orders; status and totals come from its orders.
TASKS = """
SELECT concat('task-', CAST(o_custkey AS STRING)) AS id,
  CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN 'yellowpages' WHEN 1 THEN 'yelp' ELSE 'bbb' END AS source,
  CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN 'demo' ELSE 'live' END AS mode,
  CASE CAST(o_custkey % 5 AS INT) WHEN 0 THEN 'running' WHEN 1 THEN 'failed' WHEN 2 THEN 'pending' ELSE 'completed' END AS status,
  CAST(count(*) * 100 AS BIGINT) AS total_scraped,
  CAST(count(*) * 100 - count(*) % 7 AS BIGINT) AS total_cleaned,
  CAST(CASE WHEN o_custkey % 6 = 0 THEN count(*) * 40 ELSE count(*) * 75 - o_custkey % 9 END AS BIGINT) AS total_deduped,
  max(o_orderdate) AS created_at
FROM orders GROUP BY o_custkey
"""

# Stage rows of the same tasks: four stages, each with its own loss.
STAGE_STATS = """
SELECT id AS task_id, step,
  CASE step WHEN 1 THEN 'html_cleaner' WHEN 2 THEN 'field_validator' WHEN 3 THEN 'deduplicator' ELSE 'enricher' END AS stage,
  CAST(CASE step WHEN 1 THEN total_scraped WHEN 2 THEN total_scraped WHEN 3 THEN total_cleaned ELSE total_deduped END AS BIGINT) AS count_in,
  CAST(CASE step WHEN 1 THEN total_scraped WHEN 2 THEN total_cleaned ELSE total_deduped END AS BIGINT) AS count_out,
  created_at
FROM (SELECT *, EACH(1, 2, 3, 4) AS step FROM tasks) t
"""

# Progress messages: one JSON text per event; purchase and error end a task.
PROGRESS_MESSAGES = """
SELECT CAST(event_id AS BIGINT) AS event_seq, CAST(user_id AS BIGINT) AS channel,
  CASE WHEN event_id % 41 = 0 THEN '{"type": broken'
  ELSE concat('{"type":"', CASE event_type WHEN 'purchase' THEN 'task_completed' WHEN 'error' THEN 'task_failed' ELSE 'progress' END,
    '","stage":"', event_type, '","task_id":"', CAST(user_id AS STRING),
    '","pages_processed":', CAST(event_id % 50 AS STRING),
    CASE WHEN event_id % 4 = 0 THEN ',"pages_total":null' ELSE ',"pages_total":50' END,
    ',"items_found":', CAST(event_id % 300 AS STRING), ',"errors":', CAST(event_id % 3 AS STRING), '}') END AS value
FROM events
"""

# One directory page per supplier with JSON-LD: a list of two objects, or a single object,
# or bad JSON; plus two listing containers that carry their own values.
JSON_LD_PAGES = """
SELECT CAST(s_suppkey AS BIGINT) AS page_id, 'yelp' AS source,
  concat('https://directory.example.org/s/', CAST(s_suppkey AS STRING)) AS url,
  concat('<html><body><script type="application/ld+json">',
    CASE WHEN s_suppkey % 7 = 0 THEN '{"name": oops'
    WHEN s_suppkey % 3 = 0 THEN concat('{"name":"', s_name, '","telephone":"555-', CAST(s_suppkey AS STRING), '","address":{"streetAddress":"', CAST(s_nationkey AS STRING), ' Dock St"}}')
    ELSE concat('[{"name":"', s_name, '","telephone":"555-', CAST(s_suppkey AS STRING), '"},{"name":"', s_name, ' West","telephone":"","aggregateRating":{"ratingValue":"4.', CAST(s_suppkey % 10 AS STRING), '"}}]') END,
    '</script><div data-testid="serp-ia-card"><a class="css-19v1rkv">Card A', CAST(s_suppkey AS STRING),
    '</a><p class="css-1p9ibgf">555-0001</p></div><div data-testid="serp-ia-card"><a class="css-19v1rkv">Card B', CAST(s_suppkey AS STRING),
    '</a><p class="css-1p9ibgf">555-0002</p></div></body></html>') AS html
FROM supplier
"""

# One app-state page per supplier; entities sit under a map of cache keys. Every fourth
# page has no state and only listing rows.
APP_STATE_PAGES = """
SELECT CAST(s_suppkey AS BIGINT) AS page_id, 'crunchbase' AS source,
  concat('https://discover.example.org/', CAST(s_suppkey AS STRING)) AS url,
  CASE WHEN s_suppkey % 4 = 0 THEN concat('<html><body><div class="component--grid-row"><a class="component--field-formatter" href="/o/', CAST(s_suppkey AS STRING), '">Grid ', s_name, '</a></div></body></html>')
  ELSE concat('<html><body><script id="ng-state" type="application/json">{&quot;HttpState&quot;:{&quot;GET&quot;:{&quot;k', CAST(s_suppkey AS STRING),
    '&quot;:{&quot;body&quot;:{&quot;entities&quot;:[{&quot;name&quot;:&quot;', s_name, ' &amp;amp; Co&quot;,&quot;website_url&quot;:&quot;https://s', CAST(s_suppkey AS STRING),
    '.example.org&quot;,&quot;categories&quot;:[&quot;Tech&quot;,&quot;B', CAST(s_nationkey AS STRING), '&quot;]},{&quot;identifier&quot;:{&quot;value&quot;:&quot;', s_name,
    ' Two&quot;},&quot;homepage_url&quot;:&quot;https://two.example.org&quot;,&quot;location_identifiers&quot;:[{&quot;value&quot;:&quot;Town ', CAST(s_nationkey AS STRING),
    '&quot;}]},{&quot;website_url&quot;:&quot;https://anonymous.example.org&quot;}]}}}}}</script></body></html>') END AS html
FROM supplier
"""

# Crawled company sites: one site per row of ``pages``, with its home page and three contact
# paths. Bodies are the whole page plus contact and social snippets.
SITE_PAGES = """
SELECT concat('http://shop', CAST(page_id AS STRING), '.example.org/a/b') AS url, path,
  CAST(CASE WHEN page_id % 10 = 0 THEN 404 WHEN page_id % 10 = 1 THEN 405 ELSE 200 END AS INT) AS status_head,
  CAST(CASE WHEN page_id % 20 = 11 THEN 500 WHEN path = '/about' AND page_id % 3 = 0 THEN 404 ELSE 200 END AS INT) AS status_get,
  concat(html, CASE path
    WHEN '' THEN concat(' <a href="https://www.linkedin.com/company/c', CAST(page_id AS STRING), '">in</a>', CASE WHEN page_id % 2 = 0 THEN ' <a href="https://x.com/c2">x</a>' ELSE '' END)
    WHEN '/contact' THEN CASE WHEN page_id % 4 = 0 THEN ' info@shop.example.org nobody@sentry.io ' ELSE '' END
    WHEN '/about' THEN concat(' Sales@x.example.org owner', CAST(page_id AS STRING), '@shop.example.org ')
    ELSE concat(' <p>desk', CAST(page_id AS STRING), '@shop.example.org</p>') END) AS html
FROM (SELECT *, EACH('', '/contact', '/about', '/contact-us') AS path FROM pages) p
"""

# Search requests and stored result pages: one request per nation and supplier.
PAGE_REQUESTS = """
SELECT CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN 'yellowpages' WHEN 1 THEN 'yelp' WHEN 2 THEN 'bbb' ELSE 'clutch' END AS source,
  concat('All the plumbing and heating companies near the river, no. ', s_name, ' & Sons') AS query, concat('New  ', n_name, ', NY') AS location,
  CAST(s_suppkey % 3 AS INT) AS page
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""

# Crawl result pages: every page row of ``pages`` belongs to the crawl of its language; a
# page in nine is missing, one in eleven has no items.
CRAWL_PAGES = """
SELECT regexp_extract(html, 'lang="([a-z]+)"', 1) AS crawl, CAST(page_id AS BIGINT) AS page,
  page_id % 9 <> 4 AS fetched,
  CAST(CASE WHEN page_id % 9 = 4 OR page_id % 31 = 30 THEN 0 ELSE 1 + page_id % 5 END AS BIGINT) AS n_items
FROM pages
"""


# The directory pages of both kinds as crawls of their source and nation: some pages hold no
# listing, some could not be fetched.
FLOW_PAGES = """
SELECT concat(source, '-', CAST(s_nationkey AS STRING)) AS crawl, page_id AS page, source, page_id, url,
  CASE WHEN page_id % 9 = 4 THEN NULL WHEN page_id % 17 = 16 THEN '<html><body><p>nothing here</p></body></html>' ELSE html END AS html
FROM (SELECT * FROM ld_pages UNION ALL SELECT * FROM app_pages) p JOIN supplier ON s_suppkey = page_id
"""


def for_engine(sql: str, engine: str = "spark") -> str:
    """``EACH(a, b)`` repeats a row once per value, spelled the way the engine wants it."""
    call = r"explode(array(\1))" if engine == "spark" else r"unnest([\1])"
    return re.sub(r"EACH\(([^)]*)\)", call, sql)


def load_tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register parquet tables as temporary views."""
    for name in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def raw_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    load_tables(spark, sf_dir, "orders", "customer", "nation", "region", "part")
    return spark.sql(RAW_LEADS)


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    load_tables(spark, sf_dir, "orders")
    return spark.sql(TASKS)


def flow_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    json_ld_pages(spark, sf_dir).createOrReplaceTempView("ld_pages")
    app_state_pages(spark, sf_dir).createOrReplaceTempView("app_pages")
    return spark.sql(FLOW_PAGES)


def stage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks(spark, sf_dir).createOrReplaceTempView("tasks")
    return spark.sql(for_engine(STAGE_STATS))


def progress_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    load_tables(spark, sf_dir, "events")
    return spark.sql(PROGRESS_MESSAGES)


def json_ld_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    load_tables(spark, sf_dir, "supplier")
    return spark.sql(JSON_LD_PAGES)


def app_state_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    load_tables(spark, sf_dir, "supplier")
    return spark.sql(APP_STATE_PAGES)


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    load_tables(spark, sf_dir, "pages")
    return spark.sql(for_engine(SITE_PAGES))


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    load_tables(spark, sf_dir, "supplier", "nation")
    return spark.sql(PAGE_REQUESTS)


def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    load_tables(spark, sf_dir, "pages")
    return spark.sql(CRAWL_PAGES)


def prepared_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admitted, identified, cleaned and validated leads, stored: the input of deduplication."""
    with compiled_rules(spark):
        return stored_table(spark, "prepared_leads", sf_dir, lambda: prepare(dealt_leads(spark, sf_dir)))


def dealt_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw leads in parts of equal size; an order without a key goes where its customer goes."""
    return dealt(raw_leads(spark, sf_dir), "lead_id", "email")
