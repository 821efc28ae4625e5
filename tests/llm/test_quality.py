import numpy as np
from pyspark.sql import functions as F

from tesserine.llm import quality
from tesserine.llm.common import table
from tests.llm.helpers import docs


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    rows = quality.op10_quality(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean(held) > 0.93


def test_edges(spark):
    frame = docs(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 0), (5, 1), (None, 0), (6, None), (8, 0)], "doc_id long, quality int")
    model = quality.fit(frame, labels)
    rows = quality.score(frame, model).collect()
    assert len(rows) == frame.count() and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (2, 3, 4)}
    assert len(empty) == 1
    assert quality.score(frame.limit(0), model).collect() == []
    one = quality.fit(frame, labels.filter("quality = 1"))
    assert {r.score for r in quality.score(frame, one).collect()} == {1.0}
    none = quality.fit(frame, labels.filter("false"))
    assert {r.score for r in quality.score(frame, none).collect()} == {0.5}


def test_batches_do_not_matter():
    texts = ["", "One two. Three!", " \n", "word " * 1000, "x", "日本 語", "\n a b\n\n c"]
    x, offsets = quality.passages(texts)
    for k, t in enumerate(texts):
        own, _ = quality.passages([t])
        assert np.array_equal(own, x[offsets[k] : offsets[k + 1]])


def test_gradient():
    rng = np.random.default_rng(2)
    x, offsets = rng.normal(size=(9, 5)).astype(np.float32), np.array([0, 2, 3, 9])
    y = np.array([1.0, 0.0, 1.0])
    model = quality.Attention(x, offsets, y, epochs=1)
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    first, n = offsets[:-1], np.diff(offsets)

    def loss():
        s = model._forward(x, first, n)[-1]
        return np.mean(np.log1p(np.exp(-s)) * y + np.log1p(np.exp(s)) * (1 - y))

    grad = model._grad(x, first, n, y)
    for k, v in model.p.items():
        at = tuple(0 for _ in v.shape)
        old = v[at]
        v[at] = old + 1e-5
        up = loss()
        v[at] = old - 1e-5
        assert abs((up - loss()) / 2e-5 - grad[k][at]) < 1e-5
        v[at] = old
