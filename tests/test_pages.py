import pytest
from pyspark.sql import functions as F

from leadweave.operators import crawl, extraction
from leadweave.sources import configs, pages

import html_tree as H

CARDS = """<html><body>
<div class="result"><a class="business-name">Acme Plumbing</a><div class="phones"> (555) 111-1111 </div>
  <a class="track-visit-website" href="https://acme.com">Website</a><div class="categories"><a>Plumbing</a><a>Drains</a></div></div>
<div class="result wide"><a class="business-name">Best &amp; Co</a><div class="phones"></div></div>
<div class="result"><div class="adr">no name</div></div></body></html>"""
LD = """<html><body><script type="application/ld+json">[{"name":"One","telephone":"555-1","address":{"streetAddress":"10 St"},
 "aggregateRating":{"ratingValue":4.5}},{"name":"","telephone":"555-2"}]</script><script type='application/ld+json'>{bad</script>
<script type="application/ld+json">{"name":"Three"}</script>
<div data-testid="serp-ia-card"><a class="css-19v1rkv">Card 1</a></div><div data-testid="serp-ia-card"><a class="css-19v1rkv">Card 2</a>
<p class="css-1p9ibgf">x</p></div></body></html>"""
STATE = ('<html><body><script id="ng-state" type="application/json">{&quot;HttpState&quot;:{&quot;GET&quot;:{&quot;k&quot;:{&quot;body&quot;:{&quot;entities&quot;:['
         '{&quot;name&quot;:&quot;Acme&quot;,&quot;website_url&quot;:&quot;&quot;,&quot;homepage_url&quot;:&quot;https://h&quot;,&quot;category_groups_list&quot;:[&quot;A&quot;,&quot;B&quot;]},'
         '{&quot;identifier&quot;:{&quot;value&quot;:&quot;Two&quot;},&quot;headquarters&quot;:&quot;HQ&quot;},{&quot;x&quot;:1}]}},&quot;k2&quot;:{&quot;body&quot;:{}}}}}</script></body></html>')
GRID = '<div class="component--grid-row"><a class="component--field-formatter" href="/o">Grid</a></div>'


def page_table(spark, rows):
    return spark.createDataFrame([(i, s, f"https://p/{i}", h) for i, (s, h) in enumerate(rows)],
                                 "page_id bigint, source string, url string, html string")


@pytest.mark.parametrize("selector,want", [
    ("a.business-name::text", ["Acme Plumbing", "Best & Co"]), ("div.categories a::text", ["Plumbing", "Drains"]),
    ("a::attr(href)", ["https://acme.com"]), ("div.result > a::text", ["Acme Plumbing", "Website", "Best & Co"]),
    ("body > a::text", []), ("[class^='track']::attr(href)", ["https://acme.com"]), ("[class$=wide] a::text", ["Best & Co"]),
    ("a[href*='acme']::text", ["Website"]), ("*.adr::text", ["no name"]), ("div[class='result wide'] a::text", ["Best & Co"]),
])
def test_selectors(selector, want):
    assert list(H.select(H.parse_html(CARDS), selector)) == want


def test_unclosed_tags():
    tree = H.parse_html("<ul><li>a<li>b<br>c</ul><p>x<p>y</body>")
    assert list(H.select(tree, "li::text")) == ["a", "b", "c"]
    assert list(H.select(tree, "p::text")) == ["x", "y"]


def test_static_listings(spark):
    got = extraction.extract_pages(page_table(spark, [("yellowpages", CARDS)]), scraped_at=F.lit("t")).collect()
    assert [(r.company_name, r.phone, r.website, r.category) for r in got] == [
        ("Acme Plumbing", "(555) 111-1111", "https://acme.com", "Plumbing"), ("Best & Co", None, None, None)]
    assert got[0].source_url == "https://p/0" and got[0].extras == {}


def test_extras_and_name_alias(spark):
    rules = [{"name": "s", "renderer": "static", "listing_selector": "li",
              "selectors": {"name": "a::text", "rate": "b::text", "none": None}}]
    found = extraction.extract_listings(page_table(spark, [("s", "<li><a>N</a><b>5</b></li><li><b>6</b></li>"), ("t", "<li>")]), rules)
    assert [(r.company_name, r.extras) for r in extraction.admit_listings(found).collect()] == [("N", {"rate": "5"})]


def test_json_ld_overrides_by_position(spark):
    table = page_table(spark, [("yelp", LD)])
    ld = extraction.extract_json_ld(table).orderBy("idx").collect()
    assert [r.fields for r in ld] == [
        {"company_name": "One", "phone": "555-1", "address": "10 St", "rating": "4.5"},
        {"company_name": "", "phone": "555-2"}, {"company_name": "Three"}]
    got = extraction.extract_pages(table).orderBy("idx").collect()
    assert [(r.company_name, r.phone, r.address) for r in got] == [("One", "555-1", "10 St"), ("Card 2", "555-2", None)]


def test_app_state_and_fallback(spark):
    table = page_table(spark, [("crunchbase", STATE), ("crunchbase", GRID), ("crunchbase", STATE.replace("}}}}}<", "<") + GRID)])
    got = extraction.extract_pages(table).orderBy("page_id", "idx").collect()
    assert [(r.page_id, r.company_name, r.website, r.category, r.address) for r in got] == [
        (0, "Acme", "https://h", "A, B", ""), (0, "Two", None, None, "HQ"),
        (1, "Grid", "/o", None, None), (2, "Grid", "/o", None, None)]


def test_coverage_and_samples(spark):
    table = page_table(spark, [("yellowpages", CARDS)] * 3)
    got = {r.field: (r.pages, r.matches, r.missing) for r in extraction.selector_coverage(table).collect()}
    assert got["(listing)"] == (3, 9, False) and got["category"] == (3, 6, False) and got["company_name"] == (3, 6, False)
    samples = extraction.sample_listings(extraction.extract_listings(table)).orderBy("rank").collect()
    assert [(r.page_id, r.idx) for r in samples] == [(0, 0), (0, 1), (0, 2)]


def test_frontier(spark):
    requests = spark.createDataFrame(
        [("yellowpages", "web developers", "New York, NY"), ("yelp", "a*~b", "é"), ("clutch", "dev ops", "NY"),
         ("crunchbase", "q", "l"), ("unknown", "q", "l")], "source string, query string, location string")
    got = pages.build_frontier(requests, configs.search_configs(spark)).collect()
    urls = {(r.source, r.page): r.url for r in got}
    assert len(got) == 50 + 100 + 50 + 1
    assert urls["yellowpages", 0] == "https://www.yellowpages.com/search?search_terms=web+developers&geo_location_terms=New+York%2C+NY&page=1"
    assert urls["yelp", 3] == "https://www.yelp.com/search?find_desc=a%2A~b&find_loc=%C3%A9&start=30"
    assert urls["clutch", 1] == "https://clutch.co/dev+ops?page=2"
    assert urls["crunchbase", 0] == "https://www.crunchbase.com/discover/organization.companies?query=q&location=l"


def test_page_store(spark):
    cols = "source string, slug_query string, slug_location string, page int, html string, fetched_at int"
    old = spark.createDataFrame([("yp", "plumbing-heating", "ny", 1, "old", 1), ("yelp", "q", "l", 0, "keep", 1)], cols)
    new = spark.createDataFrame([("yp", "plumbing-heating", "ny", 1, "a", 2), ("yp", "plumbing-heating", "ny", 1, "b", 3)], cols)
    merged = pages.upsert_pages(old, new)
    ask = spark.createDataFrame([("yp", "Plumbing & Heating", "NY", 1), ("yp", "x", "NY", 1)], "source string, query string, location string, page int")
    assert {(r.query, r.html) for r in pages.lookup_pages(ask, merged).collect()} == {("Plumbing & Heating", "b"), ("x", None)}
    assert [r.query for r in pages.has_page(ask, merged).collect()] == ["Plumbing & Heating"]
    kept, dropped = pages.purge_pages(merged, "yp")
    assert [r.html for r in kept.collect()] == ["keep"] and dropped.first().purged == 1
    assert pages.purge_pages(merged)[1].first().purged == 2


def test_stop_rule_over_long_crawls(spark):
    # a page that failed is passed over, an empty one ends the crawl, page 5000 is never seen
    rows = [("a", p, p % 7 != 3, 2 if p != 4001 else 0) for p in range(5001)] + [("b", 0, False, 0), ("b", 1, True, 0), ("b", 2, True, 9)]
    table = spark.createDataFrame(rows, "crawl string, page bigint, fetched boolean, n_items bigint")
    seen = crawl.visited_pages(table)
    last = {r.crawl: r for r in seen.groupBy("crawl").agg(F.max("page").alias("page"), F.max("items_before").alias("n")).collect()}
    want = sum(2 for p in range(4001) if p % 7 != 3)
    assert (last["a"].page, last["a"].n, last["b"].page) == (4001, want, 1)
    limited = crawl.visited_pages(table, 5)
    got = {r.crawl: (r.pages_scraped, r.pages_skipped, r["items"]) for r in crawl.crawl_summary(limited, 5).collect()}
    assert got == {"a": (3, 0, 5), "b": (1, 1, 0)}
    items = table.filter("fetched").select("crawl", "page", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("idx")).filter("crawl = 'a'")
    assert crawl.limited_items(items, limited, 5).count() == 5
