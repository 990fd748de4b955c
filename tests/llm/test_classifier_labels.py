"""The classifier is fitted on the labelled documents that are there."""

import random

import corpus_pipeline
from tideloom.llm import quality_cnn


def tables(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["tea", "sun", "oak", "##"][: 4 - i % 2]) for _ in range(30))) for i in range(60)]
    labels = [(i, i % 2) for i in range(60)]
    gone = [(i, 0) for i in range(1000, 1600)]  # labels of documents that an earlier stage rejected
    return spark.createDataFrame(rows, "doc_id long, text string"), labels, gone


def test_labels_without_documents_count_for_nothing(spark):
    docs, labels, gone = tables(spark)
    fit = lambda lab, n: quality_cnn.fit(docs, spark.createDataFrame(lab, "doc_id long, quality int"), max_docs=n)
    for n in (200, 20):  # all documents, and a choice of them
        a, b = fit(labels, n), fit(labels + gone, n)
        assert not a.flat and (a.weights == b.weights).all() and a.shift == b.shift
    one = fit([x for x in labels if x[1] == 1] + gone, 200)
    assert one.flat and one.shift > 10  # the share of label 1 is 1 among those that are there


def test_stage_keeps_documents_where_one_label_is_left(spark, tmp_path):
    docs, labels, _ = tables(spark)
    for i, lab in enumerate(([x for x in labels if x[1] == 0], [])):
        spark.createDataFrame(lab, "doc_id long, quality int").write.parquet(f"{tmp_path}/{i}/labels.parquet")
        docs.write.parquet(f"{tmp_path}/{i}/documents.parquet")
        assert corpus_pipeline.classifier_stage(spark, docs, f"{tmp_path}/{i}").count() == 60


def test_stage_rejects_though_all_that_arrived_are_clean(spark, tmp_path):
    """The network is fitted on the table's labelled documents, so it knows label 0 where an earlier stage left none of it."""
    docs, labels, _ = tables(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = docs.where("doc_id % 2 = 1").unionByName(spark.createDataFrame([(2, "## tea ## ## oak ## sun ## ## ## tea ## ##")], docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.classifier_stage(spark, clean, str(tmp_path)).collect()}
    assert 2 not in kept and len(kept) >= 28


def test_bounds_hold(spark):
    docs, labels, _ = tables(spark)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    twice = docs.unionByName(docs)  # of a repeated key one row is trained on
    assert (quality_cnn.fit(docs, lab).weights == quality_cnn.fit(twice, lab).weights).all()
    assert quality_cnn.fit(docs, lab, max_bytes=10).flat
