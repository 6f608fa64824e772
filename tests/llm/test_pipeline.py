import corpus_pipeline as P
from leadweave.llm import decontamination as D
from leadweave.llm import simhash as S
from pyspark.sql import functions as F

from test_classifiers import labelled


def folder(spark, path, docs, labels, benchmark):
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    benchmark.write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_take_effect(spark, prose, tmp_path):
    docs, labels = labelled(spark, prose)
    copy = docs.filter("doc_id in (1, 2, 5)").selectExpr("doc_id + 1000 as doc_id", "text")
    item = prose(77, 60)
    dirty = spark.createDataFrame([(2000, prose(78, 100) + "\n" + item)], "doc_id long, text string")
    lang = F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit("fr"), F.lit("es")), (F.col("doc_id") % 4 + 1).cast("int"))
    table = docs.unionByName(copy).unionByName(dirty).select(
        "doc_id", F.concat(F.col("text"), F.lit("\nAll rights reserved by us")).alias("text"), lang.alias("lang"), F.lit("site").alias("source"),
        F.length("text").cast("long").alias("n_chars"))
    sf = folder(spark, tmp_path, table, labels, spark.createDataFrame([(1, item)], "item_id long, text string"))
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    out = P.run(spark, sf)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 2000 not in ids and not {1001, 1002, 1005} & set(ids)
    assert set(ids) <= good | {2000} and len(good - set(ids)) <= 3
    assert out.filter(F.col("text").contains("All rights")).count() == 0
    assert out.filter("n_chars != length(text) or rate is null or copies < 1").count() == 0
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "decontamination", "mixing"]


def test_stages_on_odd_and_empty_documents(spark, prose, odd_docs, tmp_path):
    _, labels = labelled(spark, prose, 40)
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    sf = folder(spark, tmp_path, odd_docs.select(names), labels, spark.createDataFrame([(1, prose(5, 30))], "item_id long, text string"))
    for docs in (odd_docs, odd_docs.limit(0)):
        for name, stage in P.STAGES[:-1]:
            assert stage(spark, docs, sf).columns == docs.columns, name
            assert stage(spark, docs, sf).count() <= docs.count()
        assert P.mix(spark, docs, sf).count() <= docs.count()
    assert P.run(spark, sf).count() > 0


def test_kept_rows_against_brute_force(spark, prose):
    docs = spark.createDataFrame([(k, prose(k % 7, 90)) for k in range(20)], "doc_id long, text string")
    assert sorted(r.doc_id for r in S.one_of_each(docs).collect()) == list(range(7))
    bench = spark.createDataFrame([(1, prose(3, 90))], "item_id long, text string")
    assert sorted(r.doc_id for r in D.decontaminate(docs, bench).collect()) == [k for k in range(20) if k % 7 != 3]
