"""Leads are prepared in many tasks, however few pieces the orders come in."""

import datetime

from leadweave.plans import views
from leadweave.session import even_parts


def small_tables(spark, folder, orders):
    day = datetime.date(2026, 1, 2)
    rows = {
        "orders": ([(k, c, day) for k, c in orders], "o_orderkey bigint, o_custkey bigint, o_orderdate date"),
        "customer": ([(c, 0, "FURNITURE") for c in range(1, 41)], "c_custkey bigint, c_nationkey int, c_mktsegment string"),
        "nation": ([(0, "NATION_0", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "ASIA")], "r_regionkey int, r_name string"),
        "part": ([(c, f"part {c}") for c in range(1, 41)], "p_partkey bigint, p_name string"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_prepared_in_many_tasks(spark, tmp_path):
    folder = small_tables(spark, tmp_path, [(k, 1 + k % 40) for k in range(1, 2001)] + [(7, 8), (7, 8)])
    raw = views.raw_leads(spark, folder)
    assert raw.rdd.getNumPartitions() == 1
    made = views.prepared_leads(spark, folder)
    sizes = [len(p) for p in made.select("ord").rdd.mapPartitions(lambda rows: [list(rows)]).collect()]
    files = [spark.read.parquet(f).count() for f in made.inputFiles()]
    assert sum(sizes) == sum(files) == raw.filter("company_name <> ''").count()
    assert len(files) == even_parts(spark) and max(files) < 2 * sum(files) / len(files)


def test_orders_without_key_are_dealt_by_customer(spark, tmp_path):
    folder = small_tables(spark, tmp_path, [(None, 1 + k % 40) for k in range(400)])
    parts = views.dealt_leads(spark, folder).select("email").rdd.mapPartitions(lambda rows: [len(list(rows))]).collect()
    assert sum(parts) == 400 and sum(n > 0 for n in parts) > even_parts(spark) / 2
