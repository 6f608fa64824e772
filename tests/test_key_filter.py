import re

from leadweave import schemas
from leadweave.operators import enrichment
from leadweave.operators.key_filter import key_filter
from leadweave.sources import pages
from pyspark.sql import functions as F


def test_keeps_every_key_and_few_others(spark):
    keys = spark.range(0, 2000).select((F.col("id") * 3).cast("string").alias("k")).union(spark.createDataFrame([(None,)], "k string"))
    test = key_filter(keys, F.col("k"), expected=2000)
    table = spark.range(60_000).select(F.col("id").cast("string").alias("v"))
    found = {int(r.v) for r in table.filter(test(F.col("v"))).collect()}
    assert set(range(0, 6000, 3)) <= found and len(found) < 2000 + 0.1 * 58_000
    assert spark.createDataFrame([(None,)], "v string").filter(test(F.col("v"))).count() == 0
    assert table.filter(key_filter(keys.limit(0), F.col("k"))(F.col("v"))).count() == 0


def shuffled_columns(df):
    """Names of the columns under any exchange of the plan as it was run."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    blocks = re.findall(r"\(\d+\) (?:Exchange|BroadcastExchange|ShuffleQueryStage)\n(.*?)\n\n", text, re.S)
    assert blocks
    return {c.split("#")[0].strip() for b in blocks for line in re.findall(r"Input \[\d+\]: \[(.*?)\]", b) for c in line.split(",")}


def without_broadcast(spark, fn):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return fn()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_page_bodies_stay_where_they_are(spark, tmp_path):
    lead = spark.createDataFrame([(1, f"https://a{k}.com", None) for k in range(20)], "ord int, website string, email string")
    sites = spark.createDataFrame([(f"https://a{k}.com", "", 200, 200, "body") for k in range(200)], schemas.SITE_PAGE)
    sites.write.parquet(str(tmp_path / "sites"))

    def plan():
        out = enrichment.enrich(lead, spark.read.parquet(str(tmp_path / "sites")))
        return shuffled_columns(out), out.filter("website_alive").count()

    columns, alive = without_broadcast(spark, plan)
    assert "html" not in columns and alive == 20


def test_lookup_and_upsert_move_matching_pages_only(spark, tmp_path):
    cols = "source string, slug_query string, slug_location string, page int, html string, fetched_at int"
    old = spark.createDataFrame([("yp", f"q{k}", "ny", k % 3, f"old {k}", 1) for k in range(300)], cols)
    old.write.parquet(str(tmp_path / "old"))
    stored = spark.read.parquet(str(tmp_path / "old"))
    new = spark.createDataFrame([("yp", f"q{k}", "ny", k % 3, f"new {k}", 2) for k in range(295, 310)], cols)
    ask = spark.createDataFrame([("yp", f"q{k}", "NY", k % 3) for k in range(5)], "source string, query string, location string, page int")
    merged = {r.slug_query: r.html for r in pages.upsert_pages(stored, new).collect()}
    assert merged == {f"q{k}": f"old {k}" if k < 295 else f"new {k}" for k in range(310)}
    assert {(r.query, r.html) for r in pages.lookup_pages(ask, stored).collect()} == {(f"q{k}", f"old {k}") for k in range(5)}

    def moved():
        """Rows of bodies that reach a join."""
        plan = pages.lookup_pages(ask, stored)
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        return text.index("Join") < text.index("scalar-subquery") and "Filter" in text

    assert without_broadcast(spark, moved)
    maybe = stored.filter(key_filter(new, F.struct(*pages.KEY))(F.struct(*pages.KEY)))
    assert maybe.count() < 12  # five keys are in both; the filter lets few others by
