"""What the row rules of the lead preparation pay for: Python, regular expressions, stored tables."""

import html

from pyspark.sql import functions as F

from leadweave import session
from leadweave.functions import contact, names, text
from leadweave.operators.cleaning import clean_strings
from leadweave.plans import pipeline, registry
from test_dealt import small_tables


def python_step(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return next(line for line in plan.splitlines() if "ArrowEvalPython" in line)


def test_one_call_takes_all_columns_of_a_row(spark):
    df = spark.createDataFrame(
        [(" caf&eacute; ", "R&amp;D", None), (None, None, None), ("x", "&#66;", "&copy=1 &notit; &lt;"), ("", "a&b", "&eacute;")],
        "a string, b string, c string")
    done = clean_strings(df)
    assert "pythonUDF0" in python_step(done) and "pythonUDF1" not in python_step(done)
    assert [tuple(r) for r in done.collect()] == [
        ("café", "R&D", None), (None, None, None), ("x", "B", "©=1 ¬it; <"), ("", "a&b", "é")]


def test_only_values_that_python_changes_reach_it(spark):
    plain = ["http://x.org/?a=1&id=2&b=3#top", "AT&T", "a && b", "&; &# &1;", "R&amp;D &lt;&#39;", "", "&"]
    rare = ["&eacute;", "&#65", "&#x41;", "&copy=1", "x&region", "&lt", "&amp;&hellip;", "&NotEqualTilde;"]
    df = spark.createDataFrame([(v,) for v in plain + rare], "v string").coalesce(1)
    got = [tuple(r) for r in df.select(F.col("v").rlike(text._NEEDS_FULL_TABLE), text.unescape_html(F.col("v"))).collect()]
    assert got == [(v in rare, html.unescape(v)) for v in plain + rare]


def test_addresses_of_any_length_and_last_label(column):
    long = "a" * 50_000
    good = ["a.b@x.com", "é+ü@x.org", "a@local.com", "a@test.arpa.de", "a@x.localx", "a@x.xtest"]
    bad = [long + "@x.com", ".".join(["a"] * 20_000) + "@x.com", long, "a@x.local", "a@x.TEST", "a@b.onion", "a@test", "a..b@x.com", "a\n@x.com"]
    assert column(contact.normalized_email, good + bad) == good + [None] * len(bad)


def test_extension_is_found_in_every_spelling(column):
    marks = ["x", "X", "#", "ext", "EXT.", "extn ", ";ext=", " Extension: "]
    assert column(contact.phone_start, [f"212-555-1234{m}12" for m in marks]) == ["212-555-1234"] * len(marks)


def test_legal_form_in_every_case(spark):
    rows = [(chr(n) + rest,) for n in range(1, 0x3100) for rest in ("nc", "o", "p", "td")]
    df = spark.createDataFrame([(f"acme {v[0]}",) for v in rows], "v string")
    bare = F.trim(F.regexp_replace(F.trim(F.lower("v")), "(?iU)" + names.LEGAL_SUFFIX, ""))
    assert df.filter(~names.normalize_company_name(F.col("v")).eqNullSafe(bare)).count() == 0
    assert df.filter(bare == "acme").count() > 4


def test_exports_read_companies_without_storing_them(spark, tmp_path):
    folder = small_tables(spark, tmp_path, [(k, 1 + k % 40) for k in range(1, 301)])
    made = {
        "csv": registry.export_csv(spark, folder), "json": registry.export_json(spark, folder),
        "rows": registry.export_rows(spark, folder),
    }
    counts = {name: df.count() for name, df in made.items()}
    assert ("companies", folder) not in {key[1:] for key in session._STORED}
    table = registry._companies(spark, folder).filter("is_duplicate_of IS NULL")
    for name, task in (("csv", "task-bbb"), ("json", "task-bbb"), ("rows", "task-yelp")):
        want = table.filter(F.col("task_id") == task).select(made[name].columns)
        assert counts[name] == want.count() > 0 and made[name].exceptAll(want).isEmpty()


def test_both_passes_share_one_phone_aggregate(spark, tmp_path):
    rows = [(n, str(n), f"firm {n}", f"+1{n % 5}" if n % 3 else None, f"m{n % 4}@x.com" if n % 2 else None) for n in range(60)]
    spark.createDataFrame(rows, "ord bigint, pipeline_id string, company_name string, phone_normalized string, email string") \
        .write.parquet(f"{tmp_path}/leads")
    done = pipeline.exact_passes(spark.read.parquet(f"{tmp_path}/leads")).select("pipeline_id", "_phone_absorbed", "_email_absorbed")
    got = done.collect()
    alone = sum(r.pipeline_id is not None and r._phone_absorbed == 0 and r._email_absorbed == 0 for r in got)
    assert len({r.pipeline_id for r in got}) == len(got) < 60 and alone > 0
    ran = done._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in ran


def test_exact_passes_leave_few_conditions_behind(spark, tmp_path):
    more = [f"field_{k}" for k in range(12)]
    columns = "ord bigint, pipeline_id string, company_name string, phone_normalized string, email string"
    spark.createDataFrame(
        [(n, str(n), f"firm {n}", f"+1{n % 3}", f"m{n % 2}@x.com", *[str(k) if (n + k) % 2 else None for k in range(len(more))]) for n in range(12)],
        f"{columns}, {', '.join(f'{c} string' for c in more)}").write.parquet(f"{tmp_path}/leads")
    done = pipeline.exact_passes(spark.read.parquet(f"{tmp_path}/leads"))
    # a checkpoint asks for the conditions that hold for its rows; each node goes through its own
    nodes, most = [done._jdf.queryExecution().optimizedPlan()], 0
    while nodes:
        node = nodes.pop()
        most = max(most, node.validConstraints().size())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert most < 100
    kept = session.cut_lineage(done).collect()
    assert sum(1 + r._phone_absorbed for r in kept) >= len(kept) > 0
    assert all(r[c] is not None for r in kept if r._phone_absorbed for c in more)
