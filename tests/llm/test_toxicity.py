import numpy as np
from pyspark.sql import functions as F

from tesserine.llm import langid, toxicity
from tesserine.llm.common import table
from tests.llm.helpers import docs


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    frame = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model, langs = toxicity.fit(frame, table(spark, sf, "labels").filter(~held))
    rows = frame.filter(held).join(toxicity.score(frame, model, langs), "doc_id").select("toxic", "score").collect()
    hit = [r.score >= 0.5 for r in rows if r.toxic]
    clean = [r.score < 0.5 for r in rows if not r.toxic]
    assert np.mean(hit) > 0.8 and np.mean(clean) > 0.985


def test_edges(spark):
    frame = docs(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 0), (5, 1), (None, 0), (6, None), (8, 0)], "doc_id long, toxic int")
    model, langs = toxicity.fit(frame, labels)
    rows = toxicity.score(frame, model, langs).collect()
    assert len(rows) == frame.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    assert toxicity.score(frame.limit(0), model, langs).collect() == []
    for some, want in (("toxic = 0", 0.0), ("false", 0.0)):
        found = toxicity.score(frame, *toxicity.fit(frame, labels.filter(some)))
        assert {r.score for r in found.collect()} == {want}


def test_logits_are_the_plain_network():
    rng = np.random.default_rng(0)
    texts = ["You are trash, really!", "", "a", "fine words here and there", "one two three four"]
    ids, offsets = toxicity.word_ids(texts)
    y = np.array([1, 0, 0, 0, 0], np.float32)
    net = toxicity.Cnn(ids, offsets, y, np.ones(2), epochs=1)
    net.p = {k: rng.normal(size=v.shape) for k, v in net.p.items()}
    net.p["E"][toxicity.PAD] = 0
    for k, t in enumerate(texts):
        own = ids[offsets[k] : offsets[k + 1]]
        assert np.array_equal(own, toxicity.word_ids([t])[0])
        x = net.p["E"][own].sum(axis=1)
        top = [np.max([sum(x[i + o] @ net.p[f"W{w}"][o] for o in range(w)) for i in range(len(x) - w + 1)], axis=0) for w in toxicity.WIDTHS]
        want = np.maximum(np.concatenate(top) + net.p["b"], 0) @ net.p["v"] + net.p["d"]
        assert np.allclose(net.logits(ids, offsets)[k], want)


def test_threshold():
    logit, y = np.array([-3.0, -1, 0, 2, 3]), np.array([0, 0, 1, 1, 1])
    assert -1 < toxicity.threshold(logit, y, np.ones(5)) <= 0
    assert isinstance(langid.Model([], np.zeros((0, langid.BUCKETS))).score(["a"])[0], np.ndarray)


def test_thresholds_come_from_all_labels(spark):
    """A rare language whose labels are mostly outside the network's sample has its own threshold."""
    rng = np.random.default_rng(2)
    words = {"en": ["the", "house", "green", "walk", "river"], "xx": ["zul", "qarn", "vex", "jopp", "kwil"]}
    rows = []
    for k in range(4000):
        lang, bad = ("xx" if k % 20 == 0 else "en"), k // 20 % 2
        text = " ".join(rng.choice(words[lang], 12)) + (" trash" if bad else "")
        rows.append((k, text, lang, bad))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model, langs = toxicity.fit(frame, frame.select("doc_id", "toxic"), max_each=300)
    assert {"", "en", "xx"} <= set(model.shift)
    found = {r.doc_id: r.score >= 0.5 for r in toxicity.score(frame, model, langs).collect()}
    assert np.mean([found[k] == bool(bad) for k, _, _, bad in rows]) > 0.97


def test_gradient():
    """Of the log loss by every parameter, against differences."""
    rng = np.random.default_rng(2)
    model = toxicity.Cnn.__new__(toxicity.Cnn)
    n = len(toxicity.WIDTHS) * toxicity.FILTERS
    p = model.p = {"E": rng.normal(size=(toxicity.PAD + 1, toxicity.DIM)), "v": rng.normal(size=n), "d": rng.normal(size=1), "b": rng.normal(size=n) * 0.1}
    p["E"][toxicity.PAD] = 0
    for w in toxicity.WIDTHS:
        p[f"W{w}"] = rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)) * 0.3
    ids, offsets = toxicity.word_ids(["one two three four", "five six", "one seven eight nine ten", ""])
    first, size, y = offsets[:-1], np.diff(offsets), np.array([1.0, 0, 1, 0])
    grad = model._grad(ids, first, size, y, rng, keep=1.1)  # nothing dropped, all scaled by 1 / 1.1

    def loss():
        x = p["E"][ids].sum(axis=1)
        top = []
        for w in toxicity.WIDTHS:
            r = sum(x[o : len(x) - w + 1 + o] @ p[f"W{w}"][o] for o in range(w))
            top.append(np.stack([r[a : a + n - w + 1].max(axis=0) for a, n in zip(first, size)]))
        s = np.maximum(np.concatenate(top, axis=1) + p["b"], 0) / 1.1 @ p["v"] + p["d"]
        return np.mean(np.log1p(np.exp(-np.where(y > 0, s, -s))))

    rows, dense = grad["E"]
    for name in ("v", "d", "b", "W1", "W3", "E"):
        flat = p[name].reshape(-1)
        of = np.zeros(p["E"].shape) if name == "E" else np.asarray(grad[name])
        if name == "E":
            of[rows] = dense
        picks = rng.choice(rows, 5) * toxicity.DIM if name == "E" else rng.integers(0, len(flat), 5)
        for k in picks:
            was, eps = flat[k], 1e-6
            flat[k] = was + eps
            up = loss()
            flat[k] = was - eps
            down = loss()
            flat[k] = was
            assert abs((up - down) / (2 * eps) - of.reshape(-1)[k]) < 1e-4


def test_sample_is_bounded_in_bytes(spark):
    from tesserine.llm.textnum import within_bytes

    rows = spark.createDataFrame([(k, b"x" * (1000 if k % 10 else 100_000)) for k in range(100)], "doc_id long, x binary")
    assert len(within_bytes(rows, "x", 2_000_000)) == 100
    some = within_bytes(rows, "x", 20_000)
    assert 10 <= len(some) <= 20 and set(some["x"].map(len)) == {1000}
    assert len(within_bytes(rows, "x", 100)) == 0 and len(within_bytes(rows.limit(0), "x", 100)) == 0
