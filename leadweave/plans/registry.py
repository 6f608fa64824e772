"""Every operator as a query over the star-schema tables, by name."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadweave import schemas
from leadweave.functions import contact, names, text, urls
from leadweave.functions.similarity import comparison_tokens, score_pairs
from leadweave.operators import companies as companies_op
from leadweave.operators import crawl, dashboard, enrichment, exact_dedup, extraction, fuzzy_dedup
from leadweave.operators import validation
from leadweave.operators.admission import admit, with_pipeline_id
from leadweave.operators.cleaning import clean_strings
from leadweave.plans import flow, pipeline, views
from leadweave.session import ensure_checkpoint_dir, even_parts, stored_path, stored_table
from leadweave.sources import configs, exports, leads as leads_io, pages as pages_io
from leadweave.streaming import leads as stream_leads
from leadweave.streaming import progress
from leadweave.streaming.run import drain

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _one_row(*counts: DataFrame) -> DataFrame:
    """Several one-row frames as one row, without joining them."""
    rows = counts[0]
    for more in counts[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def _text(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def _prepared(spark, sf):
    return views.prepared_leads(spark, sf)


def _companies(spark: SparkSession, sf: str) -> DataFrame:
    return stored_table(spark, "companies", sf, lambda: _company_rows(spark, sf))


def _company_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Company table of the prepared leads: a task per source, every ninth row marked as a
    duplicate, every seventh for review, one creation time per day of the year. One projection:
    a query that reads it once takes it from here, with the columns it needs; the others share
    ``_companies``."""
    lead = _prepared(spark, sf)
    typed = leads_io.to_companies(lead.withColumns({
        "needs_review": F.col("ord") % 7 == 0,
    }), "none").drop("task_id", "id", "created_at", "is_duplicate_of")
    number = F.col("pipeline_id").cast("bigint")
    return typed.withColumns({
        "id": F.concat(F.lit("c"), F.lpad("pipeline_id", 12, "0")),
        "task_id": F.concat(F.lit("task-"), F.col("source")),
        "is_duplicate_of": F.when(number % 9 == 0, F.lit("c000000000001")),
        "created_at": F.date_add(F.lit("2026-01-01").cast("date"), (number % 365).cast("int")).cast("timestamp_ntz"),
    })


# --- admission, cleaning, validation -------------------------------------------------------


@query
def raw_admit(spark, sf):
    out = admit(views.raw_leads(spark, sf)).transform(with_pipeline_id, ["source", "source_url"])
    return out.select("lead_id", "pipeline_id", "company_name", "phone", "source")


@query
def valid_raw_leads(spark, sf):
    return leads_io.valid_raw_leads(views.raw_leads(spark, sf)).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"))


@query
def clean_strings_leads(spark, sf):
    return clean_strings(admit(views.raw_leads(spark, sf))).select(
        "lead_id", "company_name", "address", "email", "city", "review_count")


@query
def clean_page_text(spark, sf):
    views.load_tables(spark, sf, "pages")
    out = clean_strings(spark.table("pages").select("page_id", "html"))
    return out.select("page_id", F.length("html").alias("chars"), F.md5("html").alias("digest"))


@query
def validate_email(spark, sf):
    return validation.validate_email(admit(views.raw_leads(spark, sf))).select(
        "lead_id", "email", "email_validated")


@query
def document_emails(spark, sf):
    views.load_tables(spark, sf, "documents")
    found = spark.table("documents").select("doc_id", F.posexplode(F.regexp_extract_all(
        "text", F.lit(r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+"), F.lit(0))).alias("pos", "email"))
    return validation.validate_email(found.withColumn("given", F.col("email")))


@query
def check_domain(spark, sf):
    lead = validation.validate_email(admit(views.raw_leads(spark, sf)))
    domains = spark.table("customer").filter("c_custkey % 7 < 5").select(
        F.concat(F.lit("mail"), (F.col("c_custkey") % 7).cast("string"), F.lit(".example.com")).alias("domain"))
    return validation.check_domain(lead, domains).select("lead_id", "email", "email_validated")


@query
def mailbox_verdicts(spark, sf):
    lead = validation.validate_email(admit(views.raw_leads(spark, sf)))
    verdicts = spark.table("customer").select(
        F.expr("concat('Contact', CAST(c_custkey % 1200 AS STRING), '@mail', CAST(c_custkey % 7 AS STRING), '.example.com')").alias("email"),
        (F.col("c_custkey") % 3 == 0).alias("accepted"))
    return validation.apply_mailbox_verdicts(lead, verdicts).select("lead_id", "email", "email_validated")


@query
def normalize_phone(spark, sf):
    return validation.normalize_phone(admit(views.raw_leads(spark, sf))).select(
        "lead_id", "phone", "phone_normalized")


@query
def normalize_phone_in_service(spark, sf):
    lead = admit(views.raw_leads(spark, sf))
    codes = spark.table("customer").filter("c_custkey % 2 = 0").select(
        (F.col("c_custkey") % 700 + 201).cast("string").alias("area_code"))
    return validation.normalize_phone(lead, codes).select("lead_id", "phone_normalized")


@query
def phone_display(spark, sf):
    return validation.normalize_phone(admit(views.raw_leads(spark, sf))).select("lead_id", "phone_display")


@query
def document_phones(spark, sf):
    views.load_tables(spark, sf, "documents")
    found = spark.table("documents").select("doc_id", F.posexplode(F.regexp_extract_all(
        "text", F.lit(r"\+1 \(\d{3}\) \d{3}-\d{4}"), F.lit(0))).alias("pos", "phone"))
    return validation.normalize_phone(found)


@query
def clean_website(spark, sf):
    return urls.clean_website(admit(views.raw_leads(spark, sf))).select("lead_id", "website")


@query
def clean_page_urls(spark, sf):
    views.load_tables(spark, sf, "pages")
    return urls.clean_website(spark.table("pages").select("page_id", "url"), "url")


@query
def normalize_name(spark, sf):
    lead = clean_strings(admit(views.raw_leads(spark, sf)).select("lead_id", "company_name"))
    return validation.normalize_name(lead)


@query
def standardize_address(spark, sf):
    lead = clean_strings(admit(views.raw_leads(spark, sf)).select("lead_id", "address", "company_name"))
    return validation.add_standard_address(lead).select("lead_id", "address_normalized")


@query
def validator_stats(spark, sf):
    return validation.validator_stats(admit(views.raw_leads(spark, sf)))


@query
def block_key(spark, sf):
    lead = validation.normalize_name(clean_strings(admit(views.raw_leads(spark, sf)).select("lead_id", "company_name")))
    return lead.groupBy(names.block_key(F.col("company_name_normalized")).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("company_name_normalized").alias("names"))


# --- deduplication -------------------------------------------------------------------------

_DEDUP_COLUMNS = ["pipeline_id", "company_name", "phone_normalized", "email", "email_validated",
                  "website", "address", "rating", "review_count"]


@query
def dedup_phone(spark, sf):
    return exact_dedup.dedup_exact(_prepared(spark, sf), "phone_normalized", "absorbed").select(
        *_DEDUP_COLUMNS, "absorbed")


@query
def dedup_email(spark, sf):
    return exact_dedup.dedup_exact(_prepared(spark, sf), "email", "absorbed").select(
        *_DEDUP_COLUMNS, "absorbed")


@query
def dedup_exact_passes(spark, sf):
    return pipeline.exact_passes(_prepared(spark, sf)).select(
        *_DEDUP_COLUMNS, F.col("_phone_absorbed").alias("phone_absorbed"),
        F.col("_email_absorbed").alias("email_absorbed"))


@query
def duplicate_map(spark, sf):
    return exact_dedup.duplicate_map(_prepared(spark, sf), "phone_normalized")


@query
def chain_duplicate_map(spark, sf):
    """Every lead that any pass removes, with the lead that stands for it at the end."""
    return pipeline.chain_duplicates(_prepared(spark, sf))


@query
def dedup_counters(spark, sf):
    by_phone = exact_dedup.dedup_exact(_prepared(spark, sf), "phone_normalized", "_phone")
    both = exact_dedup.dedup_exact(by_phone.drop("_phone"), "email", "_email")
    return _one_row(by_phone.agg(F.sum("_phone").alias("exact_phone_matches")),
                    both.agg(F.sum("_email").alias("exact_email_matches")))


@query
def completeness(spark, sf):
    lead = _prepared(spark, sf)
    return lead.select("pipeline_id", exact_dedup.non_null_fields(lead).alias("filled"))


@query
def token_set_ratio(spark, sf):
    lead = _prepared(spark, sf).select("ord", "company_name_normalized")
    tokens = comparison_tokens(F.col("company_name_normalized"), "token_set_ratio")
    left = lead.select(F.col("ord").alias("i"), tokens.alias("i_tokens"), (F.col("ord") + 1).alias("j"))
    right = lead.select(F.col("ord").alias("j"), tokens.alias("j_tokens"))
    return score_pairs(left.join(right, "j"), 0.0)


def _part_names(spark, sf):
    views.load_tables(spark, sf, "part")
    return spark.table("part").select(
        F.col("p_partkey").cast("bigint").alias("ord"),
        F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("company_name_normalized"))


@query
def candidate_pairs(spark, sf):
    return fuzzy_dedup.candidate_pairs(_part_names(spark, sf))


@query
def resolve_leaders(spark, sf):
    lead = _prepared(spark, sf).select("ord", "company_name_normalized")
    return fuzzy_dedup.record_owners(lead, fuzzy_dedup.resolve_leaders(lead))


@query
def flag_reviews(spark, sf):
    lead = _prepared(spark, sf).select("ord", "company_name_normalized")
    return fuzzy_dedup.flag_reviews(lead, fuzzy_dedup.resolve_leaders(lead))


@query
def fuzzy_counters(spark, sf):
    return fuzzy_dedup.fuzzy_counters(fuzzy_dedup.resolve_leaders(_part_names(spark, sf)))


@query
def process_leads(spark, sf):
    """The whole chain with enrichment: finished companies."""
    run = pipeline.process_batch(
        views.raw_leads(spark, sf), ["source", "source_url"], "lead_id", views.site_pages(spark, sf))
    return run.leads.select("company_name", "email", "phone_normalized", "website",
                            "website_alive", "needs_review")


# --- enrichment ----------------------------------------------------------------------------


@query
def safe_urls(spark, sf):
    views.load_tables(spark, sf, "pages")
    host = F.expr("""CASE page_id % 6 WHEN 0 THEN CASE page_id % 5 WHEN 1 THEN 'http://[0:0:0:0:0:0:0:1]/' WHEN 2 THEN 'http://[::0001]:80/'
        WHEN 3 THEN concat('https://[2001:db', page_id % 10, '::', page_id % 97, ']/') WHEN 4 THEN 'http://[::ffff:1.2.3.4]/' ELSE url END
      WHEN 1 THEN concat('http://', page_id % 256, '.', page_id * 7 % 256, '.1.', page_id % 250)
      WHEN 2 THEN concat('http://192.168.', page_id % 256, '.1/x') WHEN 3 THEN 'http://localhost:8080/'
      WHEN 4 THEN concat('ftp://', page_id, '.example.com') ELSE concat('https://172.', page_id % 256, '.0.1:443/a') END""")
    return spark.table("pages").select("page_id", host.alias("site")).withColumn(
        "safe", urls.is_safe_url(F.col("site")))


def _site_leads(spark, sf):
    sites = views.site_pages(spark, sf)
    return urls.clean_website(admit(views.raw_leads(spark, sf))), sites


@query
def website_alive(spark, sf):
    lead, sites = _site_leads(spark, sf)
    return enrichment.enrich(lead, sites).select("lead_id", "website", "website_alive")


@query
def contact_email(spark, sf):
    lead, sites = _site_leads(spark, sf)
    return enrichment.enrich(lead, sites).select("lead_id", "email")


@query
def social_links(spark, sf):
    lead, sites = _site_leads(spark, sf)
    return enrichment.enrich(lead, sites).select(
        "lead_id", F.col("social_links")["linkedin"].alias("linkedin"),
        F.col("social_links")["facebook"].alias("facebook"), F.col("social_links")["twitter"].alias("twitter"))


@query
def enrich_stats(spark, sf):
    return enrichment.enrich_stats(*_site_leads(spark, sf))


# --- pipeline counters ---------------------------------------------------------------------


@query
def stage_stats_cleaner(spark, sf):
    before = admit(views.raw_leads(spark, sf)).withColumn("pipeline_id", F.col("lead_id").cast("string"))
    return pipeline.stage_stats(before, clean_strings(before, skip=("pipeline_id",)))


@query
def task_totals(spark, sf):
    return pipeline.task_totals(views.stage_stats(spark, sf))


@query
def stage_history(spark, sf):
    return _text(pipeline.stage_history(views.stage_stats(spark, sf), "task-7"), "created_at")


def _chain(spark, sf, *more: pipeline.Stage) -> pipeline.PipelineRun:
    """The row stages and enrichment over raw leads, with their own stage table."""
    lead = admit(views.raw_leads(spark, sf)).withColumns({
        "ord": F.col("lead_id"), "pipeline_id": F.col("lead_id").cast("string")}).drop("lead_id")
    stages = [pipeline.clean_stage(), pipeline.validate_stage(), *more, pipeline.enrich_stage(views.site_pages(spark, sf))]
    return pipeline.run_pipeline(lead, stages)


@query
def chain_stage_table(spark, sf):
    """Counters the chain itself wrote."""
    table = _chain(spark, sf).stats_frame(spark, "task-1")
    shown = ["emails_validated", "emails_invalid", "phones_normalized", "websites_alive", "emails_found"]
    return table.select("task_id", "step", "stage", "count_in", "count_out", "count_removed", F.col("created_at").isNotNull().alias("timed"),
                        "error", *[F.col("details")[c].alias(c) for c in shown])


@query
def chain_totals(spark, sf):
    return pipeline.task_totals(_chain(spark, sf).stats_frame(spark, "task-1"))


@query
def saved_run(spark, sf):
    """The chain with its deduplicator, its companies saved twice by one task, and the totals of
    its stage rows beside what is in the company table then."""
    run = pipeline.process_batch(views.raw_leads(spark, sf), ["source", "source_url"], "lead_id")
    path = f"{ensure_checkpoint_dir(spark)}/companies-{uuid.uuid4().hex}"
    for _ in range(2):
        leads_io.save_companies(leads_io.to_companies(run.leads, "task-1"), path)
    saved = spark.read.parquet(path).groupBy("task_id").agg(
        F.count(F.lit(1)).alias("companies"), F.countDistinct("id").alias("ids"), F.count_if("needs_review").alias("for_review"))
    return pipeline.task_totals(run.stats_frame(spark, "task-1")).join(saved, "task_id")


@query
def chain_history(spark, sf):
    return pipeline.stage_history(_chain(spark, sf).stats_frame(spark, "task-1"), "task-1").select("step", "stage", "count_out")


@query
def chain_funnel(spark, sf):
    return dashboard.stage_funnel(_chain(spark, sf).stats_frame(spark, "task-1")).select("stage", "count_out", "diff", "colour")


@query
def chain_failure(spark, sf):
    """A stage that fails after half its work: its row has the error, the data stay, the run ends."""
    def fail(_):
        raise ValueError("no counters today")
    broken = pipeline.Stage("halver", lambda df: df.filter("ord % 2 = 0"), late_counters=fail)
    run = _chain(spark, sf, broken)
    table = run.stats_frame(spark, "task-1").select("step", "stage", "count_in", "count_out", "count_removed", "count_modified", "error")
    return table.filter("stage = 'halver'").withColumn("rows_left", F.lit(run.leads.count()).cast("bigint"))


# --- company table -------------------------------------------------------------------------

_SHOWN = ["id", "company_name", "email", "city", "rating", "source"]


@query
def typed_companies(spark, sf):
    return _text(_companies(spark, sf).select(
        "id", "company_name", "rating", "review_count", "scraped_at", "email_validated", "needs_review"), "scraped_at")


@query
def search_companies(spark, sf):
    return companies_op.search_companies(
        _companies(spark, sf), source="yelp", has_email=True, needs_review=False, search="WIDGET%NATION_1"
    ).select(_SHOWN)


@query
def company_filters(spark, sf):
    return companies_op.search_companies(
        _companies(spark, sf), task_id="task-bbb", state="ASIA", category="FURNITURE", has_phone=False
    ).select(_SHOWN)


@query
def company_count(spark, sf):
    return companies_op.company_count(companies_op.search_companies(_companies(spark, sf), city="NATION_3"))


@query
def company_page(spark, sf):
    found = companies_op.search_companies(_companies(spark, sf))
    return companies_op.company_page(found, "rating", "desc", page=3, page_size=200).select(_SHOWN)


@query
def company_last_page(spark, sf):
    """The last page by number: only the range it lies in is sorted."""
    pages = companies_op.CompanyPages(companies_op.search_companies(_companies(spark, sf)), "rating", "desc")
    return pages.page(max(1, -(-pages.total // 200)), 200).select(_SHOWN)


@query
def company_page_ascending(spark, sf):
    found = companies_op.search_companies(_companies(spark, sf), has_phone=True)
    return companies_op.company_page(found, "city", "asc", page=2, page_size=100).select(_SHOWN)


@query
def company_page_after(spark, sf):
    """The third page once more, from the last row of the second."""
    found = companies_op.search_companies(_companies(spark, sf))
    last = companies_op.company_page(found, "rating", "desc", page=2, page_size=200).select("rating", "id").tail(1)
    if not last:
        return found.limit(0).select(_SHOWN)
    return companies_op.company_page_after(found, "rating", "desc", tuple(last[0]), page_size=200).select(_SHOWN)


@query
def company_by_id(spark, sf):
    return companies_op.get_company(_companies(spark, sf), "c000000000012").select(_SHOWN)


@query
def public_view(spark, sf):
    return companies_op.public_view(_companies(spark, sf)).groupBy("source", "state").agg(
        F.count(F.lit(1)).alias("n"), F.sum("review_count").alias("reviews"),
        F.count("phone_display").alias("with_phone"))


@query
def quick_filter(spark, sf):
    return companies_op.quick_filter(_companies(spark, sf), "Red asia 4").select(_SHOWN)


@query
def grid_view(spark, sf):
    return companies_op.grid_view(
        _companies(spark, sf), {"company_name": "gizmo", "state": "eur"}, [("rating", True), ("city", False)]
    ).select(_SHOWN)


def _edits(spark, sf):
    views.load_tables(spark, sf, "supplier")
    return spark.sql("""
      SELECT concat('c', lpad(CAST(s_suppkey * 3 AS STRING), 12, '0')) AS id, 'city' AS field, concat('City ', s_nationkey) AS value, 2 AS edit_no FROM supplier
      UNION ALL SELECT concat('c', lpad(CAST(s_suppkey * 3 AS STRING), 12, '0')), 'city', 'Zwischenstand', 1 FROM supplier
      UNION ALL SELECT concat('c', lpad(CAST(s_suppkey * 3 AS STRING), 12, '0')), 'city', CAST(NULL AS STRING), 3 FROM supplier WHERE s_suppkey % 7 = 0
      UNION ALL SELECT concat('c', lpad(CAST(s_suppkey * 3 AS STRING), 12, '0')), 'email', CAST(NULL AS STRING), 1 FROM supplier WHERE s_suppkey % 2 = 0
      UNION ALL SELECT concat('c', lpad(CAST(s_suppkey * 3 AS STRING), 12, '0')), 'needs_review', 'true', 1 FROM supplier WHERE s_suppkey % 5 = 0""")


@query
def unknown_edit_ids(spark, sf):
    return companies_op.unknown_ids(_edits(spark, sf), _companies(spark, sf))


@query
def apply_edits(spark, sf):
    table, edits = _companies(spark, sf), _edits(spark, sf)
    out = companies_op.apply_edits(table, edits, F.lit("2026-12-01").cast("timestamp_ntz"))
    return _text(out.select("id", "city", "email", "needs_review", "updated_at"), "updated_at")


@query
def list_tasks(spark, sf):
    return _text(companies_op.list_tasks(views.tasks(spark, sf), 2, 20), "created_at")


@query
def task_count(spark, sf):
    return companies_op.task_count(views.tasks(spark, sf))


@query
def task_by_id(spark, sf):
    return companies_op.get_task(views.tasks(spark, sf), "task-7").select("id", "source", "status", "total_scraped")


@query
def cancel_tasks(spark, sf):
    table = views.tasks(spark, sf)
    return companies_op.cancel_tasks(table, table.filter("source = 'yelp'")).select("id", "status")


@query
def reset_mode(spark, sf):
    table = views.tasks(spark, sf)
    rows = spark.table("orders").select(
        F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("id"),
        F.concat(F.lit("task-"), F.col("o_custkey").cast("string")).alias("task_id"))
    left, kept, removed = companies_op.reset_mode(table, rows, "demo")
    return _one_row(removed, left.agg(F.count(F.lit(1)).alias("tasks_left")),
                    kept.agg(F.count(F.lit(1)).alias("companies_left")))


@query
def export_rows(spark, sf):
    return exports.export_rows(_company_rows(spark, sf), "task-yelp")


def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/exports/{name}-{uuid.uuid4().hex}"


_EXPORT_SCHEMA = T.StructType([schemas.COMPANY[c] for c in exports.EXPORT_COLUMNS])


@query
def export_csv(spark, sf):
    """Written as CSV and read back."""
    path = _scratch(spark, "csv")
    exports.export_csv(exports.export_rows(_company_rows(spark, sf), "task-bbb"), path)
    return spark.read.schema(_EXPORT_SCHEMA).option("header", True).option("escape", '"').csv(path)


@query
def export_json(spark, sf):
    """Written as JSON Lines and read back."""
    path = _scratch(spark, "json")
    exports.export_json(exports.export_rows(_company_rows(spark, sf), "task-bbb"), path)
    return spark.read.schema(_EXPORT_SCHEMA).json(path)


@query
def export_log(spark, sf):
    table = _companies(spark, sf)
    known = table.select(F.col("task_id").alias("id")).distinct()
    log = exports.run_export(spark, known, table, "task-yellowpages", "csv", _scratch(spark, "log"))
    return log.select("task_id", "format", "rows_exported")


@query
def read_raw_leads(spark, sf):
    """Raw leads written as JSON and read back under the contract."""
    path = _scratch(spark, "raw")
    views.raw_leads(spark, sf).select(schemas.RAW_LEAD.fieldNames()).write.json(path)
    return leads_io.read_raw_leads(spark, path, "json")


@query
def read_raw_leads_csv(spark, sf):
    """Columns in another order, two of them missing."""
    path = _scratch(spark, "raw-csv")
    given = [c for c in reversed(schemas.RAW_LEAD.fieldNames()) if c not in ("rating", "scraped_at")]
    views.raw_leads(spark, sf).select(given).write.option("header", True).option("escape", '"').csv(path)
    return leads_io.read_raw_leads(spark, path, "csv")


@query
def read_raw_leads_parquet(spark, sf):
    path = _scratch(spark, "raw-parquet")
    given = [c for c in reversed(schemas.RAW_LEAD.fieldNames()) if c != "city"]
    views.raw_leads(spark, sf).select(given).write.parquet(path)
    return leads_io.read_raw_leads(spark, path, "parquet")


# --- dashboards ----------------------------------------------------------------------------


@query
def dashboard_kpis(spark, sf):
    return dashboard.dashboard_kpis(views.tasks(spark, sf))


@query
def recent_tasks(spark, sf):
    return dashboard.recent_tasks(views.tasks(spark, sf)).select(
        "id", "source", "status", "total_scraped", "total_deduped", "yield_pct", "good_yield")


@query
def last_completed(spark, sf):
    return dashboard.last_completed(views.tasks(spark, sf)).select("id", "source", "total_deduped")


@query
def stage_funnel(spark, sf):
    return dashboard.stage_funnel(views.stage_stats(spark, sf)).select(
        "task_id", "stage", "count_out", "diff", "colour")


@query
def progress_pct(spark, sf):
    events = progress.parse_progress(views.progress_messages(spark, sf))
    return dashboard.progress_pct(events).select("event_seq", "indeterminate", "percent")


# --- pages, crawls, extraction -------------------------------------------------------------


@query
def slug(spark, sf):
    views.load_tables(spark, sf, "pages")
    return spark.table("pages").select("page_id", text.slug(F.col("url")).alias("slug"))


@query
def frontier(spark, sf):
    requests = views.page_requests(spark, sf).drop("page").distinct()
    return pages_io.build_frontier(requests, configs.search_configs(spark))


def _snapshots(spark, sf):
    requests = pages_io.with_page_key(views.page_requests(spark, sf))
    stored = requests.withColumns({
        "url": F.concat(F.lit("https://d.example.org/"), F.col("slug_query")),
        "html": F.concat(F.lit("<p>"), F.col("query"), F.lit("</p>")),
        "fetched_at": F.lit("2026-01-01").cast("timestamp_ntz"),
    }).drop("query", "location")
    return stored.filter("page < 2"), stored


@query
def page_lookup(spark, sf):
    snapshots, _ = _snapshots(spark, sf)
    return pages_io.lookup_pages(views.page_requests(spark, sf), snapshots)


@query
def page_exists(spark, sf):
    snapshots, _ = _snapshots(spark, sf)
    return pages_io.has_page(views.page_requests(spark, sf), snapshots)


@query
def page_upsert(spark, sf):
    snapshots, stored = _snapshots(spark, sf)
    newer = stored.filter("page > 0").withColumns({
        "html": F.concat(F.lit("<b>"), F.col("slug_query"), F.lit("</b>")),
        "fetched_at": F.lit("2026-02-01").cast("timestamp_ntz")})
    return pages_io.upsert_pages(snapshots, newer).select(*pages_io.KEY, "html")


@query
def page_purge(spark, sf):
    kept, dropped = pages_io.purge_pages(_snapshots(spark, sf)[1], "yelp")
    return _one_row(dropped, kept.agg(F.count(F.lit(1)).alias("kept")))


PAGE_RULES = [{
    "name": "web", "renderer": "static", "listing_selector": "html",
    "selectors": {"company_name": "article > h1::text", "category": "nav li a::text",
                  "website": "nav li a::attr(href)", "state": "html::attr(lang)",
                  "address": "div.ad::text"},
}]


def _web_pages(spark, sf):
    views.load_tables(spark, sf, "pages")
    return spark.table("pages").withColumn("source", F.lit("web"))


@query
def listings(spark, sf):
    """Every web page read through selectors: one container per page."""
    return extraction.admit_listings(
        extraction.extract_listings(_web_pages(spark, sf), PAGE_RULES), F.lit("2026-01-01")
    ).select("page_id", "idx", "company_name", "category", "website", "state", "address", "source_url")


@query
def selector_coverage(spark, sf):
    return extraction.selector_coverage(_web_pages(spark, sf), PAGE_RULES)


@query
def sample_listings(spark, sf):
    found = extraction.extract_listings(views.json_ld_pages(spark, sf))
    return extraction.sample_listings(found).select("source", "rank", "page_id", "idx")


@query
def json_ld(spark, sf):
    found = extraction.extract_json_ld(views.json_ld_pages(spark, sf))
    fields = ["company_name", "phone", "address", "rating"]
    return found.select("page_id", "idx", *[F.col("fields")[f].alias(f) for f in fields])


@query
def merge_by_position(spark, sf):
    pages = views.json_ld_pages(spark, sf)
    merged = extraction.merge_by_position(extraction.extract_listings(pages), extraction.extract_json_ld(pages))
    return merged.select("page_id", "idx", *[
        F.col("fields")[f].alias(f) for f in ("company_name", "phone", "address", "rating")])


@query
def app_state(spark, sf):
    found = extraction.extract_app_state(views.app_state_pages(spark, sf))
    return found.select("page_id", "idx", *[
        F.col("fields")[f].alias(f) for f in ("company_name", "website", "category", "address")])


@query
def extract_pages(spark, sf):
    pages = views.json_ld_pages(spark, sf).unionByName(views.app_state_pages(spark, sf))
    return extraction.extract_pages(pages, scraped_at=F.lit("2026-01-01")).select(
        "source", "page_id", "idx", "company_name", "phone", "website", "source_url")


@query
def stop_rule(spark, sf):
    return crawl.visited_pages(views.crawl_pages(spark, sf), 60)


@query
def crawl_items(spark, sf):
    pages = views.crawl_pages(spark, sf)
    items = pages.filter("fetched AND n_items > 0").select(
        "crawl", "page", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_items") - 1)).alias("idx"))
    return crawl.limited_items(items, crawl.visited_pages(pages, 60), 60)


@query
def crawl_summary(spark, sf):
    return crawl.crawl_summary(crawl.visited_pages(views.crawl_pages(spark, sf), 60), 60)


@query
def pages_to_companies(spark, sf):
    """Stored pages to saved companies: crawls end by the stop rule over their own listings."""
    path = f"{ensure_checkpoint_dir(spark)}/companies-{uuid.uuid4().hex}"
    order = F.col("page_id") * 10 + F.col("idx") * 2 + (F.col("source") == "yelp").cast("int")
    done = flow.pages_to_companies(views.flow_pages(spark, sf), order, "task-1", path, limit=12, scraped_at=F.lit("2026-01-01"))
    saved = spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("companies"), F.count_if("needs_review").alias("for_review"))
    crawls = done.summary.groupBy(F.split_part("crawl", F.lit("-"), F.lit(1)).alias("source")).agg(
        F.count(F.lit(1)).alias("crawls"), F.sum("pages_scraped").alias("pages_scraped"),
        F.sum("pages_skipped").alias("pages_skipped"), F.sum("items").alias("items"))
    return crawls.join(saved, "source", "left")


# --- progress messages ---------------------------------------------------------------------


def _events(spark, sf):
    return progress.parse_progress(views.progress_messages(spark, sf))


_EVENT = ["channel", "event_seq", "type", "stage", "pages_processed", "pages_total", "items_found", "errors"]


@query
def parse_progress(spark, sf):
    return _events(spark, sf).select(_EVENT)


@query
def latest_progress(spark, sf):
    return progress.latest_progress(_events(spark, sf)).select(_EVENT)


@query
def until_terminal(spark, sf):
    return progress.until_terminal_batch(_events(spark, sf)).select(_EVENT)


@query
def stage_changes(spark, sf):
    return progress.stage_changes_batch(_events(spark, sf)).select(_EVENT)


def _event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf) \
        .createOrReplaceTempView("events")
    return progress.parse_progress(spark.sql(views.PROGRESS_MESSAGES))


@query
def latest_progress_stream(spark, sf):
    return progress.latest_progress(drain(progress.latest_changes(_event_stream(spark, sf)))).select(_EVENT)


@query
def until_terminal_stream(spark, sf):
    return drain(progress.until_terminal(_event_stream(spark, sf))).select(_EVENT)


@query
def stage_changes_stream(spark, sf):
    return drain(progress.stage_changes(_event_stream(spark, sf))).select(_EVENT)


@query
def clean_leads_stream(spark, sf):
    """Row stages on a stream: contact names of customer rows, cleaned and validated."""
    schema = spark.read.parquet(f"{sf}/customer.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "customer.parquet").parquet(sf)
    lead = rows.select(
        "c_custkey", F.concat(F.lit("  "), F.col("c_name"), F.lit(" &amp;  Sons LLC")).alias("company_name"),
        F.concat(F.col("c_mktsegment"), F.lit("@Mail.Example.com")).alias("email"))
    return drain(validation.normalize_name(validation.validate_email(clean_strings(lead))))


def _reference_tables(spark):
    """Domains that take mail and verdicts on mailboxes, from customers."""
    customer = spark.table("customer")
    domains = customer.filter("c_custkey % 7 < 5").select(
        F.concat(F.lit("mail"), (F.col("c_custkey") % 7).cast("string"), F.lit(".example.com")).alias("domain"))
    verdicts = customer.select(
        F.expr("concat('Contact', CAST(c_custkey % 1200 AS STRING), '@mail', CAST(c_custkey % 7 AS STRING), '.example.com')").alias("email"),
        (F.col("c_custkey") % 3 == 0).alias("accepted"))
    return {"mail_domains": domains, "verdicts": verdicts}


@query
def prepare_leads_stream(spark, sf):
    """All row rules on all lead columns of a stream, with reference tables, saved by batch. The
    files are many and of equal size; a trigger takes a third of them."""
    raw = views.dealt_leads(spark, sf)
    folder = stored_path(spark, "raw_leads", sf, lambda: raw)
    files = -(-even_parts(spark) // 3)
    leads = stream_leads.prepared(stream_leads.read_raw(spark, folder, files), **_reference_tables(spark))
    return stream_leads.drain_leads(leads).select(_PREPARED)


_PREPARED = ["pipeline_id", "company_name", "company_name_normalized", "phone_normalized", "phone_display", "email", "email_validated",
             "website", "address_normalized", "city", "rating", "review_count"]
