import json

import pytest
from pyspark.sql import functions as F

from leadweave import schemas
from leadweave.operators import companies, dashboard, enrichment
from leadweave.plans import pipeline
from leadweave.sources import exports, leads
from leadweave.streaming import progress
from leadweave.streaming.run import drain


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f"c{i}", f"Name {i} GmbH", f"+1{i}", None if i % 2 else f"m{i}@x.com", "NY" if i < 3 else None, i / 2 if i else None,
             "c0" if i == 4 else None, i == 5, "t1") for i in range(6)]
    df = spark.createDataFrame(rows, "id string, company_name string, phone string, email string, state string, rating double, "
                                     "is_duplicate_of string, needs_review boolean, task_id string")
    empty = {f.name: F.lit(None).cast(f.dataType) for f in schemas.COMPANY if f.name not in df.columns}
    return df.withColumns(empty)


def ids(df):
    return [r.id for r in df.collect()]


def test_search_sort_page(table):
    assert set(ids(companies.search_companies(table))) == {"c0", "c1", "c2", "c3", "c5"}
    assert set(ids(companies.search_companies(table, has_email=True))) == {"c0", "c2"}
    assert ids(companies.search_companies(table, search="M2@X")) == ["c2"]
    assert ids(companies.search_companies(table, needs_review=True)) == ["c5"]
    live = companies.search_companies(table)
    assert ids(companies.company_page(live, "rating", "desc", 1, 2)) == ["c0", "c5"]
    assert ids(companies.company_page(live, "rating", "asc", 2, 3)) == ["c5", "c0"]
    assert ids(companies.company_page(live, "state", "asc", 1, 3)) == ["c0", "c1", "c2"]
    for bad in ({"sort_by": "email"}, {"page": 0}, {"page_size": 201}):
        with pytest.raises(ValueError):
            companies.company_page(live, **bad)
    with pytest.raises(LookupError):
        companies.get_company(table, "nope")
    assert companies.public_view(table).columns == companies.PUBLIC_COLUMNS
    assert ids(companies.quick_filter(table, "gmbh M2@")) == ["c2"]
    assert ids(companies.grid_view(table, {"company_name": "NAME"}, [("rating", True)]))[:2] == ["c5", "c4"]


def test_edits(spark, table):
    edits = spark.createDataFrame([("c1", "city", "Rome"), ("c2", "email", None), ("c2", "needs_review", "true")], "id string, field string, value string")
    companies.check_edits(edits)
    got = {r.id: r for r in companies.apply_edits(table, edits).collect()}
    assert got["c1"].city == "Rome" and got["c2"].email is None and got["c2"].needs_review and got["c1"].updated_at
    assert got["c0"].updated_at is None and got["c0"].email == "m0@x.com"
    with pytest.raises(ValueError):
        companies.check_edits(spark.createDataFrame([("c1", "rating", "5")], "id string, field string, value string"))


def test_filters_reach_the_scan(table, tmp_path, spark):
    table.write.parquet(str(tmp_path / "c"))
    plan = companies.search_companies(spark.read.parquet(str(tmp_path / "c")), source="x", has_email=True).select("id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "IsNull(is_duplicate_of)" in text and "EqualTo(source,x)" in text and "IsNotNull(email)" in text
    assert "website" not in text


def test_exports(spark, table, tmp_path):
    tasks = spark.createDataFrame([("t1",)], "id string")
    out = str(tmp_path / "csv")
    log = exports.run_export(spark, tasks, table, "t1", "csv", out).first()
    assert (log.rows_exported, log.format, log.file_path) == (5, "csv", out)
    part = next(p for p in sorted((tmp_path / "csv").glob("part-*")) if p.stat().st_size)
    data = part.read_bytes()
    assert data.startswith(b"\xef\xbb\xbfcompany_name,phone,email,")
    exports.run_export(spark, tasks, table, "t1", "json", str(tmp_path / "json"))
    lines = [json.loads(x) for p in (tmp_path / "json").glob("part-*") for x in p.read_text("utf-8").splitlines()]
    assert len(lines) == 5 and list(lines[0]) == exports.EXPORT_COLUMNS
    with pytest.raises(ValueError):
        exports.run_export(spark, tasks, table, "t1", "excel", out)
    with pytest.raises(LookupError):
        exports.run_export(spark, tasks, table, "t9", "csv", out)


def test_read_and_typed_save(spark, tmp_path):
    (tmp_path / "raw.json").write_text('{"company_name":"A","rating":"4.5","review_count":3,"source":"s","source_url":"u","scraped_at":"2026-01-01T00:00:00Z"}\n'
                                       '{"company_name":"B","rating":"A+","scraped_at":"soon"}\n')
    raw = leads.read_raw_leads(spark, str(tmp_path / "raw.json"), "json")
    assert raw.columns == schemas.RAW_LEAD.fieldNames() and leads.valid_raw_leads(raw).count() == 1
    saved = leads.to_companies(raw.withColumn("pipeline_id", F.col("company_name")), "t")
    got = {r.company_name: r for r in saved.collect()}
    assert got["A"].rating == 4.5 and str(got["A"].scraped_at) == "2026-01-01 00:00:00" and got["A"].email_validated is False
    assert got["B"].rating is None and got["B"].scraped_at is None and got["B"].task_id == "t"
    leads.save_companies(saved, str(tmp_path / "companies"))
    assert spark.read.parquet(str(tmp_path / "companies")).count() == 2


def raw(spark, n=5):
    return spark.createDataFrame(
        [(f"Company {'abcdefgh'[i] * 9}", f"+1-212-555-{i:04d}", f"Info{i}@company{i}.com", f"https://company{i}.com/", f"{i} Main St", "4.5", i)
         for i in range(n)] + [("", None, None, None, None, None, 99)],
        "company_name string, phone string, email string, website string, address string, rating string, lead_id bigint")


def test_pipeline_run(spark):
    sites = spark.createDataFrame([("https://company1.com", "", 405, 200, '<a href="https://x.com/c1">'),
                                   ("https://company2.com", "", 404, 404, "")], schemas.SITE_PAGE)
    run = pipeline.process_batch(raw(spark), ["lead_id"], "lead_id", sites)
    assert [s["stage"] for s in run.stats] == ["html_cleaner", "field_validator", "deduplicator", "enricher"]
    assert all(s["error"] is None for s in run.stats), run.stats
    assert [s["count_out"] for s in run.stats] == [5, 5, 5, 5]
    assert run.stats[0]["count_modified"] == 0 and run.stats[1]["count_modified"] == 5
    assert run.stats[1]["details"]["phones_normalized"] == 5
    assert run.stats[2]["details"]["exact_phone_matches"] == 0
    assert run.stats[3]["details"] == {"websites_checked": 5, "websites_alive": 1, "emails_found": 0, "social_links_found": 1}
    assert run.stats_frame(spark, "t").count() == 4


def test_dedup_counters_in_run(spark):
    doubled = raw(spark).unionByName(raw(spark).withColumn("lead_id", F.col("lead_id") + 100))
    run = pipeline.process_batch(doubled, ["lead_id"], "lead_id")
    assert run.stats[2]["count_out"] == 5 and run.stats[2]["count_removed"] == 5
    assert run.stats[2]["details"] == {"exact_phone_matches": 5, "exact_email_matches": 0, "fuzzy_auto_merged": 0,
                                       "fuzzy_flagged_review": 0, "total_duplicates": 5}


def test_one_cut_is_left(spark):
    from pathlib import Path

    from leadweave.session import ensure_checkpoint_dir

    def runs():
        return set(Path(ensure_checkpoint_dir(spark).removeprefix("file:")).rglob("run-*"))

    before = runs()
    run = pipeline.process_batch(raw(spark), ["lead_id"], "lead_id")
    assert run.leads.count() == 5 and all(s["error"] is None for s in run.stats)
    (folder,) = runs() - before
    assert [p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.is_dir()] == ["deduplicator"]

    def broken(df):
        return df.withColumn("phone", F.when(F.col("ord") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("phone")))

    # row stages are written together; the one that fails is named, and what stood before stays
    rows = raw(spark).withColumns({"pipeline_id": F.col("lead_id").cast("string"), "ord": F.col("lead_id")})
    before = runs()
    bad = pipeline.run_pipeline(rows, [pipeline.clean_stage(), pipeline.Stage("broken", broken, by_row=True), pipeline.validate_stage()])
    assert [(s["stage"], s["error"] is None) for s in bad.stats] == [("html_cleaner", True), ("broken", False)]
    assert bad.leads.count() == 6 and bad.stats[1]["count_out"] == 6
    (folder,) = runs() - before
    assert [p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.is_dir()] == ["html_cleaner"]


def test_failure_and_skip(spark):
    df = raw(spark).withColumns({"pipeline_id": F.col("lead_id").cast("string"), "ord": F.col("lead_id")})

    def broken(x):
        return x.withColumn("phone", F.raise_error(F.lit("Stage failed")))

    bad = pipeline.Stage("error", broken)
    run = pipeline.run_pipeline(df, [pipeline.clean_stage(), bad, pipeline.validate_stage()])
    assert [s["stage"] for s in run.stats] == ["html_cleaner", "error"]
    assert "Stage failed" in run.stats[1]["error"] and run.stats[1]["count_out"] == 6 and run.leads.count() == 6
    skipped = pipeline.run_pipeline(df, [pipeline.clean_stage(), pipeline.Stage("drop", lambda x: x.filter("lead_id = 1"))], ("html_cleaner",))
    assert [(s["stage"], s["count_in"], s["count_out"], s["count_removed"]) for s in skipped.stats] == [("drop", 6, 1, 5)]


def test_enrichment(spark):
    lead = spark.createDataFrame([(1, "https://a.com", None), (2, "http://10.0.0.1", None), (3, None, None), (4, "https://b.com/", "x@y.z"),
                                  (5, "https://none.com", None), (6, "https://c.com", "")], "n int, website string, email string")
    sites = spark.createDataFrame([
        ("https://a.com", "", 200, 200, "x"), ("https://a.com", "/contact", None, 404, "no@one.com"),
        ("https://a.com", "/about", None, 200, "Info@a.com b@sentry.io Me@A.com you@a.com"), ("https://a.com", "/contact-us", None, 200, "late@a.com"),
        ("https://b.com", "", 405, 204, "https://facebook.com/b"), ("https://c.com", "", 200, 200, "<a href='https://www.linkedin.com/company/c'>https://twitter.com/c</a>"),
        ("https://c.com", "/contact-us", None, 200, "c@c.com")], schemas.SITE_PAGE)
    got = {r.n: (r.website_alive, r.email, r.social_links) for r in enrichment.enrich(lead, sites).collect()}
    assert got == {1: (True, "Me@A.com", None), 2: (None, None, None), 3: (None, None, None), 4: (True, "x@y.z", None),
                   5: (False, None, None), 6: (True, "c@c.com", {"linkedin": "https://www.linkedin.com/company/c", "twitter": "https://twitter.com/c"})}


def test_dashboards(spark):
    tasks = spark.createDataFrame([("a", "completed", 200, 190, 100, 1), ("b", "running", 0, 0, 0, 2), ("c", "pending", 3, 3, 1, 3)],
                                  "id string, status string, total_scraped bigint, total_cleaned bigint, total_deduped bigint, created_at int")
    assert tuple(dashboard.dashboard_kpis(tasks).first()) == (3, 2, 1, 203, 193, 101, 102, 50)
    assert [(r.id, r.yield_pct, r.good_yield) for r in dashboard.recent_tasks(tasks, 2).collect()] == [("c", 33, False), ("b", 0, False)]
    assert dashboard.last_completed(tasks).first().id == "a"
    stats = spark.createDataFrame([("t", s, i, n) for i, (s, n) in enumerate(
        [("scraped", 1200), ("cleaned", 1150), ("validated", 1100), ("deduped", 950), ("exported", 950)])],
        "task_id string, stage string, step int, count_out bigint").withColumn("created_at", F.col("step"))
    got = {r.stage: (r["diff"], r.colour) for r in dashboard.stage_funnel(stats).collect()}
    assert got == {"scraped": (None, None), "cleaned": (-50, "yellow"), "validated": (-50, "yellow"), "deduped": (-150, "red"), "exported": (0, "green")}
    assert dashboard.dashboard_kpis(tasks.limit(0)).first().yield_pct == 0


def test_task_edits(spark):
    tasks = spark.createDataFrame([("a", "demo", "running"), ("b", "live", "completed"), ("c", "live", "pending")], "id string, mode string, status string")
    asked = spark.createDataFrame([("a",), ("b",)], "id string")
    assert {r.id: r.status for r in companies.cancel_tasks(tasks, asked).collect()} == {"a": "cancelled", "b": "completed", "c": "pending"}
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, task_id string")
    left, kept, removed = companies.reset_mode(tasks, rows)
    assert {r.id for r in left.collect()} == {"b", "c"} and {r.n for r in kept.collect()} == {2, 3} and removed.first()[0] == 1


MESSAGES = [(1, 7, "progress", "scraping"), (2, 7, "progress", "scraping"), (3, 7, "progress", "cleaning"), (4, 7, "results_update", None),
            (5, 7, "task_completed", None), (6, 7, "progress", "late"), (1, 8, "progress", "scraping"), (2, 8, "task_failed", None), (70000, 9, "progress", "a"),
            (140000, 9, "progress", "a"), (140001, 9, "progress", "b")]


def test_progress_batch_and_stream(spark, tmp_path):
    rows = [(s, c, json.dumps({"type": t, "stage": g, "pages_processed": s % 100})) for s, c, t, g in MESSAGES] + [(9, 7, "{broken")]
    schema = "event_seq bigint, channel bigint, value string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "m"))
    batch = progress.parse_progress(spark.read.parquet(str(tmp_path / "m")))
    stream = lambda: progress.parse_progress(progress.read_messages(spark, str(tmp_path / "m")))

    def keys(df):
        return sorted((r.channel, r.event_seq) for r in df.collect())

    assert batch.count() == len(MESSAGES)
    assert keys(progress.latest_progress(batch)) == [(7, 6), (8, 2), (9, 140001)]
    until = [(7, 1), (7, 2), (7, 3), (7, 4), (7, 5), (8, 1), (8, 2), (9, 70000), (9, 140000), (9, 140001)]
    assert keys(progress.until_terminal_batch(batch)) == until
    changes = [(7, 1), (7, 3), (7, 4), (7, 6), (8, 1), (8, 2), (9, 70000), (9, 140001)]
    assert keys(progress.stage_changes_batch(batch)) == changes
    assert keys(drain(progress.until_terminal(stream()))) == until
    assert keys(drain(progress.stage_changes(stream()))) == changes
    assert keys(progress.latest_progress(drain(progress.latest_changes(stream())))) == [(7, 6), (8, 2), (9, 140001)]
    bars = dashboard.progress_pct(spark.createDataFrame([(1, 3), (1, None), (1, 0), (1, 8)], "pages_processed int, pages_total int"))
    assert [tuple(r)[2:] for r in bars.collect()] == [(False, 33), (True, 0), (True, 0), (False, 13)]
