"""Texts that are scored together are bounded in bytes, not only in rows."""

import numpy as np
import pyarrow as pa
import pytest

from tideloom.llm import quality_cnn


def test_parts_are_bounded_and_whole(spark, monkeypatch):
    monkeypatch.setattr(quality_cnn, "PART_BYTES", 1000)
    texts = ["a" * 600, "b" * 600, None, "", "c" * 5000, "d" * 400, "e" * 600, "é" * 300] + ["f"] * 450
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    for whole in (batch, batch.slice(1)):
        got = list(quality_cnn.parts(whole, "text"))
        assert pa.Table.from_batches(got).to_pylist() == whole.to_pylist()
        for p in got:
            sizes = [len((t or "").encode()) for t in p["text"].to_pylist()]
            assert p.num_rows <= quality_cnn.PART_ROWS and (sum(sizes) <= 1000 or len(sizes) == 1)
    assert list(quality_cnn.parts(batch.slice(0, 0), "text")) == []


def test_long_texts_score_as_they_do_alone(spark):
    rng = np.random.default_rng(2)
    net = quality_cnn.Network(rng.normal(0, 0.15, (4, 256, 16)), np.zeros(16), rng.normal(0, 0.1, 16), rng.normal(0, 0.1, 16), 0.0)
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode() for n in (3 << 20, 1 << 20, 3 << 20, 10)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["score"] for r in quality_cnn.score_documents(docs, net, carry=["doc_id"]).collect()}
    tables = net.tables()
    assert got == pytest.approx({i: float(net.score([(t or "").encode()], tables)[0]) for i, t in enumerate(texts)}, abs=1e-12)
