"""Headline timings. Prints one JSON line.

``BENCH_SF_DIR`` picks the data folder, ``BENCH_CPUS`` the number of local cores. Every query
runs to its last row (``noop`` sink or an aggregate over the full result). Tables that later
steps start from are written first and timed on their own (``prepare_leads``)."""

import json
import os
import re
import sys
import time

from leadweave.plans import pipeline, views
from leadweave.plans.registry import QUERIES
from leadweave.session import build_session

HEADLINE = [
    "clean_page_text", "validator_stats", "dedup_phone", "dedup_exact_passes", "duplicate_map",
    "token_set_ratio", "candidate_pairs", "resolve_leaders", "website_alive", "contact_email",
    "search_companies", "company_page", "quick_filter", "apply_edits", "public_view",
    "dashboard_kpis", "stage_funnel", "frontier", "listings", "json_ld", "app_state",
    "stop_rule", "latest_progress", "until_terminal", "stage_changes", "until_terminal_stream",
]


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    took = {}

    def timed(name, action):
        if only and name not in only:
            return
        start = time.time()
        action()
        took[name] = round(time.time() - start, 3)

    views.load_tables(spark, folder)
    spark.range(1).count()
    timed("prepare_leads", lambda: views.prepared_leads(spark, folder).count())
    for name in HEADLINE:
        timed(name, lambda fn=QUERIES[name]: run(fn(spark, folder)))
    timed("process_batch", lambda: pipeline.process_batch(
        views.raw_leads(spark, folder), ["source", "source_url"], "lead_id",
        views.site_pages(spark, folder)).leads.count())
    spark.stop()
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(took.values()), 3),
        "unit": "sec", "queries": took, "sf": float(scale.group(1)) if scale else folder,
    }))


if __name__ == "__main__":
    main()
