from pathlib import Path

import pytest
from leadweave.operators.companies import CompanyPages, company_page, get_company
from leadweave.sources import commits
from pyspark.sql import functions as F

PAGES = "source string, slug_query string, slug_location string, page int, html string, fetched_at int"


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def store(spark, path):
    rows = [(s, f"q{k}", "ny", k, f"old {s} {k}", 1) for s in ("yelp", "bbb", "a b/c=1") for k in range(6)]
    spark.createDataFrame(rows, PAGES).write.partitionBy("source").parquet(str(path))
    return str(path)


def content(spark, path):
    return {(r.source, r.page): r.html for r in spark.read.parquet(path).collect()}


def test_upsert_and_purge_touch_their_partitions(spark, tmp_path):
    path = store(spark, tmp_path / "pages")
    before = files(path)
    new = spark.createDataFrame([("yelp", "q2", "ny", 2, "new", 5), ("yelp", "q9", "ny", 9, "nine", 5), ("own", "q1", "ny", 1, "own", 5)], PAGES)
    commits.commit_upsert(spark, path, new)
    got = content(spark, path)
    assert len(got) == 20 and got["yelp", 2] == "new" and got["yelp", 3] == "old yelp 3" and got["own", 1] == "own"
    after = files(path)
    assert {f: t for f, t in before.items() if "yelp" not in f}.items() <= after.items()
    assert not [f for f in before if "source=yelp" in f and f in after]
    assert commits.commit_purge(spark, path, "a b/c=1") == 6 and commits.commit_purge(spark, path, "none") == 0
    assert {s for s, _ in content(spark, path)} == {"yelp", "bbb", "own"}
    assert {f: t for f, t in after.items() if "source=bbb" in f}.items() <= files(path).items()
    assert commits.commit_purge(spark, path) == 14 and not files(path)


def test_a_change_that_fails_leaves_the_table(spark, tmp_path):
    path = store(spark, tmp_path / "pages")
    before = files(path)

    def broken(old):
        return old.withColumn("html", F.when(F.col("page") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("html")))

    with pytest.raises(Exception, match="no"):
        commits.replace_partitions(spark, path, "source", ["yelp", "bbb"], broken)
    assert files(path) == before and len(content(spark, path)) == 18


def companies(spark, n=60):
    rows = [(f"c{k:03d}", f"t{k % 3}", f"Name {k}", "city" if k % 4 else None, float(k % 5) if k % 6 else None) for k in range(n)]
    return spark.createDataFrame(rows, "id string, task_id string, company_name string, city string, rating double").withColumn(
        "updated_at", F.lit(None).cast("timestamp_ntz"))


def test_edits_and_resets_touch_their_tasks(spark, tmp_path):
    path = str(tmp_path / "companies")
    companies(spark).write.partitionBy("task_id").parquet(path)
    before = files(path)
    edits = spark.createDataFrame([("c004", "city", "Rome"), ("c007", "company_name", None)], "id string, field string, value string")
    commits.commit_edits(spark, path, edits)
    got = {r.id: r for r in spark.read.parquet(path).collect()}
    assert len(got) == 60 and got["c004"].city == "Rome" and got["c007"].company_name is None and got["c004"].updated_at
    assert {f: t for f, t in before.items() if "task_id=t1" not in f}.items() <= files(path).items()
    for bad in (("c999", "city", "x"), ("c001", "id", "x")):
        standing = files(path)
        with pytest.raises((LookupError, ValueError)):
            commits.commit_edits(spark, path, spark.createDataFrame([bad], "id string, field string, value string"))
        assert files(path) == standing
    commits.commit_reset(spark, path, ["t0", "unknown"])
    assert {r.task_id for r in spark.read.parquet(path).collect()} == {"t1", "t2"}


@pytest.mark.parametrize("by,way", [("rating", "desc"), ("rating", "asc"), ("city", "desc"), ("company_name", "asc")])
def test_pages_by_number_at_any_depth(spark, by, way):
    table = companies(spark)
    pages = CompanyPages(table, by, way, ranges=8)
    assert pages.total == 60
    for number, size in ((1, 7), (5, 7), (9, 7), (10, 7), (2, 50), (1, 200), (30, 7)):
        want = [r.id for r in company_page(table, by, way, number, size).collect()]
        assert [r.id for r in pages.page(number, size).collect()] == want
    most = max(n for _, n in pages.counts)
    found, before = pages.ranges_of(56, 4)
    assert sum(n for r, n in pages.counts if r in found) <= 2 * most and before <= 56
    assert CompanyPages(table.limit(0), by, way).page(1).count() == 0
    with pytest.raises(LookupError):
        get_company(table.union(table), "c001")
