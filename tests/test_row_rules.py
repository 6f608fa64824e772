"""Row rules: what needs cleaning, and the setting under which prepared leads are written."""

import html
import re

from pyspark.sql import functions as F

from leadweave.functions.text import clean_text, needs_cleaning
from leadweave.plans import views

GONE = "\u200b\u200c\u200d\ufeff\u00ad"


def plain(value):
    text = html.unescape(value)
    return re.sub(r"\s+", " ", "".join(c for c in text if c not in GONE)).strip(" ")


def test_every_character_beside_printable_ones(spark):
    odd = [chr(n) for n in (*range(1, 0x3100), 0xFEFF, 0x1F600) if not 0xD800 <= n < 0xE000]
    values = [f"a{c}b" for c in odd] + [f" {c}{c} x\n" for c in odd] + ["", " ", "  ", "a  b", "a\n", "R&amp;D  &lt;", "~"]
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v string")
    got = dict(df.select("n", clean_text(F.col("v"))).collect())
    assert [got[n] for n in range(len(values))] == [plain(v) for v in values]
    found = {r[0] for r in df.filter(needs_cleaning(F.col("v"))).select("n").collect()}
    assert found == {n for n, v in enumerate(values) if re.search("[^ -%'-~]|  ", v)}


def test_leads_are_prepared_by_compiled_methods(spark, tmp_path, monkeypatch):
    name, seen = "spark.sql.codegen.hugeMethodLimit", []
    monkeypatch.setattr(views, "stored_table", lambda *_: seen.append(spark.conf.get(name)))
    before = spark.conf.get(name)
    views.prepared_leads(spark, str(tmp_path))
    assert seen == ["8000"] and spark.conf.get(name) == before
