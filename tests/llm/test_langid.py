import zlib

import numpy as np
from pyspark.sql import functions as F

from tesserine.llm import langid
from tesserine.llm.common import table
from tests.llm.helpers import docs


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in table(spark, sf, "documents").collect()}
    rows = langid.op7_language(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert np.mean(held) > 0.97


def test_edges(spark):
    frame = docs(spark)
    model = langid.fit(frame)
    rows = langid.identify(frame, model).collect()
    assert len(rows) == frame.count()
    by = {r.doc_id: r for r in rows}
    assert all((by[k].lang_pred, by[k].score) == ("und", 0) for k in (2, 3, 4))
    assert all(r.lang_pred == "en" for k, r in by.items() if k not in (2, 3, 4))
    assert langid.identify(frame.limit(0), model).collect() == []
    none = langid.fit(frame.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify(frame, none).collect()} == {"und"}


def test_score_is_naive_bayes():
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b"], rng.integers(0, 50, (2, langid.BUCKETS)).astype(float))
    texts = ["abc déf 12", "", "x", "zzz"]
    best, score = model.score(texts)
    for k, t in enumerate(texts):
        two, three, _ = langid.grams([t])
        used = [x for x in [*two, *three] if x]
        if not used:
            assert best[k] == -1
            continue
        logs = model.logs[:, used].astype(float).sum(axis=1)
        p = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        assert best[k] == p.argmax() and abs(score[k] - p.max()) < 1e-4


def test_more_than_a_hundred_languages(spark):
    """Each language has letters of its own; all of them are learnt, the rarest too."""
    rows = []
    for k in range(130):
        a = 0x4E00 + 10 * k
        rows += [(len(rows) + j, "".join(chr(a + (j + i) % 9) for i in range(20)), f"l{k:03d}") for j in range(3 if k < 120 else 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in langid.identify(frame, langid.fit(frame)).collect()}
    assert all(found[i] == lang for i, _, lang in rows)
