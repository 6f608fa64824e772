"""Keys that stay apart, tables that fit their readers, inputs that are refused, hot keys that are dealt out."""

import pytest
from pyspark.sql import functions as F

from leadweave.functions import urls
from leadweave.operators import companies, dashboard
from leadweave.operators.exact_dedup import dedup_exact
from leadweave.operators.validation import check_domain
from leadweave.plans import pipeline
from leadweave.session import salted_join
from leadweave.sources import configs, leads, pages

import html_tree as H


def test_long_queries_are_different_pages(spark):
    long = "the best plumbing and heating companies of the whole valley, part "
    rows = [("bbb", long + x, "here", 0) for x in ("one", "two")]
    requests = spark.createDataFrame(rows, "source string, query string, location string, page int")
    stored = pages.with_page_key(requests).withColumns({"html": F.col("query"), "fetched_at": F.lit(1)}).drop("query", "location")
    first = stored.filter("html like '%one'")
    both = pages.upsert_pages(first, stored.filter("html like '%two'"))
    assert both.count() == 2
    assert {r.query: r.html for r in pages.lookup_pages(requests, both).collect()} == {r[1]: r[1] for r in rows}


def test_unknown_sources_are_refused(spark):
    requests = spark.createDataFrame([("nowhere", "q", "l")], "source string, query string, location string")
    with pytest.raises(ValueError, match="nowhere"):
        configs.check_sources(requests)
    configs.check_sources(requests.limit(0))


@pytest.mark.parametrize("selector", ["h1 + p", "li:nth-child(2)", "a ~ b", "p::before", "", "a,"])
def test_selectors_not_understood_are_refused(selector):
    with pytest.raises(ValueError):
        list(H.select(H.parse_html("<h1>a</h1>"), selector))


def test_comma_lists_in_document_order():
    tree = H.parse_html("<h1>a</h1><p>b<span>c</span></p><h1>d</h1>")
    assert list(H.select(tree, "span::text, h1::text")) == ["a", "c", "d"]


def test_v6_spellings(column):
    cases = {"http://[0:0:0:0:0:0:0:1]/": False, "http://[::0001]:80/x": False, "http://[2606:4700::1111]/": True, "http://[2606:4700:0:0:0:0:0:1]": True,
             "http://[1::2::3]/": False, "http://[fe80::1%25eth0]/": False, "http://[::ffff:8.8.8.8]/": False, "http://[2001:0db8::1]/": False}
    assert column(urls.is_safe_url, list(cases)) == list(cases.values())


def test_csv_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('source,review_count,company_name,other\nyelp,12,"A ""B"" Co",x\nyelp,many,C,\n')
    got = leads.read_raw_leads(spark, str(tmp_path), "csv").collect()
    assert [(r.company_name, r.review_count, r.source, r.email) for r in got] == [('A "B" Co', 12, "yelp", None), ("C", None, "yelp", None)]


def test_last_edit_wins(spark):
    table = spark.createDataFrame([("c1", "Old", None), ("c2", "Old", None)], "id string, city string, updated_at timestamp_ntz")
    edits = spark.createDataFrame([("c1", "city", "Zwolle", 1), ("c1", "city", "Assen", 2), ("c2", "city", "Zwolle", 1), ("c2", "city", None, 2), ("c9", "city", "x", 1)],
                                  "id string, field string, value string, edit_no int")
    assert {r.id: r.city for r in companies.apply_edits(table, edits).collect()} == {"c1": "Assen", "c2": None}
    assert [r.id for r in companies.unknown_ids(edits, table).collect()] == ["c9"]
    with pytest.raises(LookupError):
        companies.check_edits(edits, table)
    with pytest.raises(ValueError):
        companies.apply_edits(table, edits.withColumn("field", F.lit("rating")))


def test_pages_by_key_equal_pages_by_number(spark):
    rows = [(f"c{k:02d}", float(k % 4) if k % 5 else None) for k in range(23)]
    table = spark.createDataFrame(rows, "id string, rating double")
    for direction in ("asc", "desc"):
        last, seen = None, []
        for page in range(1, 8):
            want = [tuple(r) for r in companies.company_page(table, "rating", direction, page, 4).select("rating", "id").collect()]
            if last:
                got = companies.company_page_after(table, "rating", direction, last, 4).select("rating", "id").collect()
                assert [tuple(r) for r in got] == want
            last = want[-1] if want else last
            seen += want
        assert len(seen) == 23


def test_keyless_rows_are_never_grouped(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", "", 1), ("c", "k", 2), ("d", "k", 3)], "company_name string, email string, ord long")
    assert sorted(r.company_name for r in dedup_exact(df, "email").collect()) == ["a", "b", "c"]


def test_stage_table_fits_its_readers(spark):
    df = spark.range(10).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("pipeline_id"), F.lit("x").alias("name"))
    def fail(_):
        raise ValueError("late")
    stages = [pipeline.Stage("field_validator", lambda d: d.withColumn("name", F.when(F.col("ord") < 3, "y").otherwise(F.col("name")))),
              pipeline.Stage("deduplicator", lambda d: d.filter("ord < 6")), pipeline.Stage("enricher", lambda d: d.limit(1), late_counters=fail)]
    run = pipeline.run_pipeline(df, stages)
    table = run.stats_frame(spark, "t")
    assert [(s["count_in"], s["count_out"], s["count_modified"]) for s in run.stats] == [(10, 10, 3), (10, 6, 0), (6, 6, 0)]
    assert run.leads.count() == 6 and run.stats[2]["error"] == "late"
    assert tuple(pipeline.task_totals(table).first())[1:] == (10, 10, 6)
    assert [r.step for r in pipeline.stage_history(table, "t").collect()] == [1, 2, 3]
    assert [r["diff"] for r in dashboard.stage_funnel(table).orderBy("step").collect()] == [None, -4, 0]


def test_hot_and_missing_keys_are_dealt_out(spark):
    big = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then null when id % 3 = 1 then 'hot' else cast(id as string) end as k")
    small = spark.createDataFrame([("hot", 1), ("2", 2)], "k string, v int")
    dealt = salted_join(big, small.groupBy("k").agg(F.max("v").alias("v")), "k").withColumn("part", F.spark_partition_id())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}
        assert dealt.filter("k = 'hot' and v = 1").count() == 1000 and dealt.count() == 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(parts.values()) < 1800 and len(parts) == 4


def test_domains_of_hot_providers(spark):
    rows = [(f"a{k}@hot.com" if k % 2 else None, True) for k in range(40)] + [("b@cold.com", True)]
    got = check_domain(spark.createDataFrame(rows, "email string, email_validated boolean"), spark.createDataFrame([("HOT.com",)], "domain string"))
    assert got.filter("email is not null and email_validated").count() == 20 and got.count() == 41
    assert got.filter("not email_validated").count() == 1


def test_only_one_process_may_use_a_folder_of_its_own():
    from leadweave.session import one_machine

    assert one_machine("local") and one_machine("local[4]") and one_machine("local[*]")
    assert not one_machine("local-cluster[3,2,1024]") and not one_machine("spark://host:7077") and not one_machine("yarn")
