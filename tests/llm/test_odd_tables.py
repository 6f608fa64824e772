"""Tables the operators must take as they are: working names as columns, ids of any type."""

import pytest
from leadweave.llm import decontamination, host_reputation, line_dedup, mixing, paragraph_sketch, quality_attention, simhash
from leadweave.llm import chat_repair as C
from leadweave.llm import toxicity_segments as T
from pyspark.sql import functions as F

from test_chat_and_urls import RULES
from test_classifiers import labelled

#: Names the operators work with, and names of their results.
WORKING = (
    "given id own body own_print print root rows n n_ host _host of mark own_mark _mark _of _id _n _least _text _lines _kept _with _pages _line old kept "
    "text0 text1 print0 bucket guest hash following first_id to bits part failed n_lines n_dropped domain rate copies posterior n_words path rule lower "
    "verdict url score toxicity quality_score _quality_score overlap overlap_of_benchmark _overlap_of_benchmark p0 l0 e0 _row _words _w _b "
    "fingerprint component_id label _label number pair near cells").split()


@pytest.fixture
def crowded(spark, prose):
    docs, labels = labelled(spark, prose, 60)
    own = [F.lit(f"own {c}").alias(c) for c in WORKING]
    return docs.select("doc_id", "text", F.lit("site").alias("source"), *own), labels


def untouched(out, but=()):
    """Every working name keeps the value it was given."""
    checks = [F.sum(F.when(F.col(f"`{c}`") == f"own {c}", 0).otherwise(1)).alias(c) for c in WORKING if c not in but]
    return {k: v for k, v in out.agg(*checks).first().asDict().items() if v}


def test_columns_of_working_names_pass_through(spark, crowded, prose):
    docs, labels = crowded
    n = docs.count()
    bench = spark.createDataFrame([(1, prose(3, 40))], "item_id long, text string")
    domains = docs.select("doc_id", F.lit("a").alias("domain"))
    for name, out in {
        "lines": line_dedup.drop_boilerplate(docs), "near": simhash.one_of_each(docs),
        "quality": quality_attention.keep_good(docs, labels), "bench": decontamination.decontaminate(docs, bench),
    }.items():
        assert out.columns == docs.columns, name
        assert not untouched(out), name
        assert 0 < out.count() <= n, name
    judged = line_dedup.judged_lines(docs)
    assert not untouched(judged, ("n_lines", "n_dropped")) and judged.columns[-2:] == ["n_lines", "n_dropped"]
    mixed = mixing.apply_mix(docs, domains, {"a": 1.0, "b": 0.0})
    assert not untouched(mixed, ("domain", "rate", "copies")) and mixed.count() == n
    rated = mixing.mix(docs, domains, {"a": 1.0}, keep=("doc_id", "p0", "given", "_row"))
    assert rated.filter("p0 = 'own p0' and given = 'own given' and _row = 'own _row'").count() == n
    following = paragraph_sketch.with_next(docs).select("given.*")
    assert not untouched(following) and following.columns == [c for c in docs.columns if c != "text"]
    found = paragraph_sketch.compare(docs, "text", ["body"]).select("given.*")
    assert not untouched(found, ("body",))
    pages = docs.select(F.col("doc_id").alias("page_id"), *[c for c in WORKING if c != "url"]).withColumn("url", F.lit("http://a.example.com/x"))
    urls = host_reputation.filter_urls(pages, RULES, spark.createDataFrame([(1, 1)], "page_id long, bad int"))
    assert not untouched(urls, ("host", "path", "rule", "rate", "lower", "verdict", "url")) and urls.count() == n


@pytest.mark.parametrize("kind", ["string", "int", "decimal(20,0)"])
def test_ids_of_any_type(spark, crowded, kind):
    docs, labels = crowded
    docs = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), "text", "source")
    labels = labels.withColumn("doc_id", F.col("doc_id").cast(kind))
    model = quality_attention.learn(docs, labels)
    assert model.weights and quality_attention.score(docs, model).count() == docs.count()
    assert quality_attention.keep_good(docs, labels).schema == docs.schema
    assert T.score(docs, T.learn(docs, labels)).count() == docs.count()
    assert simhash.one_of_each(docs).schema == docs.schema


def test_repeated_ids_of_unequal_texts_keep_a_row_per_component(spark, prose):
    a, b, c = prose(1, 90), prose(2, 90), prose(3, 90)

    def kept(rows):
        return sorted(map(tuple, simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)

    assert kept([(1, a), (1, b), (2, c)]) == sorted([(1, a), (1, b), (2, c)], key=str)
    assert kept([(1, a), (2, b), (2, a)]) == sorted([(1, a), (2, b)], key=str)
    assert kept([(1, a), (1, a), (1, b), (3, b), (None, c), (None, c), (None, a)]) == sorted([(1, a), (1, b), (None, c)], key=str)


def test_rows_alike_split(spark):
    """A third of the table is one row: it falls to several parts, and costs stay those of one task."""
    turns = [(k % 20, k // 20, ["user", "assistant"][k // 20 % 2], f"t{k}") for k in range(240)] + [(7, 3, "assistant", "again")] * 120
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = C.repair_roles(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(out) == len(turns)
    for conv in range(20):
        roles = [r for _, _, r, _ in sorted(t for t in turns if t[0] == conv)]
        chosen, last = C.repair([C.role_number(r) for r in roles])
        assert sum(r.cost for r in out if r.conv_id == conv) == sum(x.cost for x in chosen) + C.endings()[last][0]
    assert sum(r.action == "merge" for r in out if r.conv_id == 7) >= 119


def test_toxic_counts_cover_all_labelled_rows(spark, prose):
    rows = [(k, prose(k, 40) + (" vileword" if k % 3 == 0 else "")) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in rows], "doc_id long, toxic int")
    whole, part = T.learn(docs, labels), T.learn(docs, labels, limit=60)
    assert (whole.scores == part.scores).all() and part.curve is not None
    got = T.score(docs, part).filter((F.col("toxicity.score") >= 0.5) == (F.col("doc_id") % 3 == 0)).count()
    assert got == len(rows)
