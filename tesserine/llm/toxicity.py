"""Toxicity: a convolutional text classifier, trained in numpy.

Words (runs of letters, in lower case) and their prefixes are hashed into a table of embeddings. Filters of several
widths slide over all words of the whole text; each filter's largest response in the text, through
a rectifier, feeds one logistic unit. Training uses Adam on at most ``max_each`` labelled documents
of either class, drawn by a hash of their id, of ``max_bytes`` together at most; the intercept is then set back to the true shares of
the classes. For each language a threshold with the fewest weighted errors is chosen on all
labelled rows that the network has not seen (a fifth of the draw, and whatever was not drawn), from
counts by language and binned logit, and the score is shifted so that it is 0.5 there. The language is that which the naive Bayes model reads from the text itself.

Scoring applies the filters once to each distinct word of a batch and then only adds rows.

Nulls and edge cases: a null text or one without letters is a row of padding and is scored like any
other; rows without a label or doc_id are not learnt from; a document with several labels is toxic if
any says so; with labels of one class only, every document scores that class's share; repeated rows
score alike; an empty table gives no rows; language, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm import langid
from tesserine.llm.common import freed, slices, table
from tesserine.llm.quality import labelled, sigmoid
from tesserine.llm.textnum import POWERS, codes, letters, mix, powers, remainder, within_bytes, words

BUCKET_BITS, DIM, FILTERS, WIDTHS = 15, 12, 16, (1, 2, 3)
PAD = 1 << BUCKET_BITS
#: A word's embedding is the sum of those of the word and of its first letters, if it has more.
PREFIXES = (4, 5, 7)
MAX_EACH = 4_000
#: Bytes of the sample's word buckets that reach the driver, 16 a word.
MAX_BYTES = 96 << 20
#: Toxic rows of a language below which the common threshold holds.
LEAST_OF_LANG = 30
#: Bins of a logit's unit in the counts that the thresholds come from, and the largest logit there.
BINS, MOST = 64, 16


def word_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of every word and of its prefixes, offsets of the texts). Each text ends in as many
    rows of pads as the widest filter has places, so that every text has a window."""
    flat, bounds = codes([t.lower() for t in texts])
    flat = np.where(letters()[flat], flat, 32)
    start, stop = words(flat)
    size = stop - start
    at = np.arange(len(flat))
    if len(start):
        at[start[0] :] -= np.repeat(start, np.diff(np.append(start, len(flat))))
    value = np.where(flat == 32, np.uint64(0), (flat.astype(np.uint64) + np.uint64(1)) * powers()[at % POWERS])
    so_far = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    n = np.bincount(np.searchsorted(bounds, start, side="right") - 1, minlength=len(texts))
    offsets = np.concatenate([[0], np.cumsum(n + max(WIDTHS))])
    out = np.full((offsets[-1], 1 + len(PREFIXES)), PAD, np.int32)
    place = np.repeat(offsets[:-1] - (np.cumsum(n) - n), n) + np.arange(len(start))
    for k, length in enumerate((None, *PREFIXES)):
        end = stop if length is None else np.minimum(start + length, stop)
        bucket = mix(so_far[end] - so_far[start] + np.uint64(length or 0)) >> np.uint64(64 - BUCKET_BITS)
        out[place, k] = bucket if length is None else np.where(size > length, bucket, PAD)
    return out, offsets


class Cnn:
    def __init__(self, ids: np.ndarray, offsets: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 4e-3, embed_rate: float = 0.2, blank: float = 0.5):
        """``weight``: (documents of class 0, of class 1) for one in the sample."""
        rng = np.random.default_rng(5)
        self.shift: dict[str, float] = {}
        self.constant = None
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.0
            return
        p = self.p = {"E": rng.normal(size=(PAD + 1, DIM)).astype(np.float32) * 0.02, "v": rng.normal(size=len(WIDTHS) * FILTERS).astype(np.float32) * 0.3, "d": np.zeros(1, np.float32), "b": np.zeros(len(WIDTHS) * FILTERS, np.float32)}
        p["E"][PAD] = 0
        for w in WIDTHS:
            p[f"W{w}"] = (rng.normal(size=(w, DIM, FILTERS)) / np.sqrt(w * DIM)).astype(np.float32)
        m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        size, step = np.diff(offsets), 0
        for epoch in range(epochs):
            now = rate * (1 - epoch / epochs)
            for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
                n = size[part]
                at = np.repeat(offsets[:-1][part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                own = ids[at]
                own[rng.random(len(own)) < blank] = PAD  # so that no text is told by one of its words alone
                grad = self._grad(own, np.cumsum(n) - n, n, y[part], rng)
                step += 1
                for k, g in grad.items():
                    if k == "E":  # plain steps: rows grow with the evidence for them, so rare words stay small
                        rows, g = g
                        p[k][rows] -= np.float32(embed_rate * now / rate) * len(part) * g
                        continue
                    g = g + 1e-4 * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        p["d"] += np.log(weight[1] / weight[0]).astype(np.float32)

    def _grad(self, ids, first, n, y, rng, keep: float = 0.8):
        p = self.p
        x = p["E"][ids].sum(axis=1)
        ends = first + n
        best, top = [], []  # place and value of each filter's largest response, by text
        for w in WIDTHS:
            r = sum(x[o : len(x) - w + 1 + o] @ p[f"W{w}"][o] for o in range(w))
            hit = np.stack([a + r[a : b - w + 1].argmax(axis=0) for a, b in zip(first, ends, strict=True)])
            best.append(hit)
            top.append(np.take_along_axis(r, hit, axis=0) if len(r) else hit * 0.0)
        raw = np.concatenate(top, axis=1) + p["b"]
        drop = (rng.random(raw.shape) < keep) / np.float32(keep)
        z = np.maximum(raw, 0) * drop
        ds = (sigmoid(z @ p["v"] + p["d"]) - y) / len(y)
        dz = (ds[:, None] * p["v"] * drop * (raw > 0)).astype(np.float32)
        grad = {"v": ds @ z, "d": ds.sum(keepdims=True), "b": dz.sum(axis=0)}
        places, values = [], []
        for k, w in enumerate(WIDTHS):
            g, hit = dz[:, k * FILTERS : (k + 1) * FILTERS], best[k]
            gw = np.zeros_like(p[f"W{w}"])
            for o in range(w):
                gw[o] = np.einsum("nf,nfd->df", g, x[hit + o])
                places.append(ids[hit + o].ravel())  # a word's gradient goes to each of its rows
                values.append(np.repeat((g[:, :, None] * p[f"W{w}"][o].T[None]).reshape(-1, DIM), ids.shape[1], axis=0))
            grad[f"W{w}"] = gw
        places, values = np.concatenate(places), np.concatenate(values)
        rows, back = np.unique(places, return_inverse=True)
        ge = np.zeros((len(rows), DIM), np.float32)
        np.add.at(ge, back, values)
        grad["E"] = (rows[rows != PAD], ge[rows != PAD])
        return grad

    def logits(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Logit of each text. The filters are applied once to each distinct word."""
        key = mix(ids[:, 0].astype(np.uint64) + sum(ids[:, k].astype(np.uint64) << np.uint64(16 * k) for k in range(1, ids.shape[1])))
        _, one, inverse = np.unique(key, return_index=True, return_inverse=True)
        x = self.p["E"][ids[one]].sum(axis=1)
        top, left = [], np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(ids))  # rows to the text's end
        for w in WIDTHS:
            r = (x @ self.p[f"W{w}"][0])[inverse]
            for o in range(1, w):
                r[: len(ids) - o] += (x @ self.p[f"W{w}"][o])[inverse[o:]]
            r[left < w] = -np.inf  # windows that would leave the text
            top.append(np.maximum.reduceat(r, offsets[:-1], axis=0))
        return np.maximum(np.concatenate(top, axis=1) + self.p["b"], 0) @ self.p["v"] + self.p["d"]

    def score(self, texts: list[str], langs: langid.Model) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        found = self.logits(*word_ids(texts)).astype(float)
        best, _ = langs.score(texts)
        names = [*langs.langs, "und"]
        return sigmoid(found - np.array([self.shift.get(names[k], self.shift.get("", 0.0)) for k in best]))

    def calibrate(self, counts, n: dict) -> None:
        """Set each language's threshold, as a logit, from ``counts``: the number (n) of labelled
        documents that were not trained on by lang, bin and y. ``n``: labelled documents of each class."""
        if self.constant is not None or not len(counts):
            return
        of = counts.groupby("y")["n"].sum()
        cost = counts["n"] * counts["y"].map({y: n[y] / of[y] for y in of.index})
        logit, y = (counts["bin"].to_numpy(float) + 0.5) / BINS, counts["y"].to_numpy()
        self.shift[""] = threshold(logit, y, cost.to_numpy(float))
        for lang, own in counts.groupby("lang"):
            sizes = own.groupby("y")["n"].sum()
            if lang != "und" and min(sizes.get(0, 0), sizes.get(1, 0)) >= LEAST_OF_LANG:
                at = counts["lang"].to_numpy() == lang
                self.shift[lang] = threshold(logit[at], y[at], cost.to_numpy(float)[at])


def threshold(logit: np.ndarray, y: np.ndarray, cost: np.ndarray) -> float:
    """The logit with the least cost of errors; in the middle of the widest best gap on ties."""
    order = np.argsort(logit, kind="stable")
    s, c = logit[order], np.where(y[order] > 0, cost[order], -cost[order])
    total = np.concatenate([[0], np.cumsum(c)])  # rises by missed toxic rows, falls by freed clean ones
    left, right = np.concatenate([[s[0] - 1], s]), np.concatenate([s, [s[-1] + 1]])
    gap = np.where(total <= total.min() + 1e-9, right - left, -1)
    k = int(gap.argmax())
    return float((left[k] + right[k]) / 2)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", max_each: int = MAX_EACH, max_bytes: int = MAX_BYTES) -> tuple[Cnn, langid.Model]:
    """The classifier and the language model, learnt from the labelled documents."""
    own = labelled(labels, label_col)
    n = {r.y: r["count"] for r in own.groupBy("y").count().collect()}
    buckets = 1 << 20
    share = F.create_map(*[F.lit(x) for y in (0, 1) for x in (y, min(buckets, max_each * buckets // max(1, n.get(y, 0))))])[F.col("y")]
    own = own.withColumn("drawn", F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(buckets)) < share)
    # a fifth of the drawn, for the thresholds
    own = own.withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(5)) == 0)
    drawn = own.filter("drawn AND NOT aside").select("doc_id", "y")
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    chosen = cols.join(F.broadcast(drawn), "doc_id")
    # texts meet only samples, which are bounded and so broadcast: neither here nor below do they cross a shuffle
    known = cols.filter("lang IS NOT NULL").select("doc_id", "lang").join(own.select("doc_id"), "doc_id").dropDuplicates(["doc_id"])
    _, spoken = langid.draw(known, 2 * max_each)
    langs = langid.fit(cols.join(F.broadcast(spoken.select("doc_id")), "doc_id"), "text", "lang", per_lang=2 * max_each)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, texts in slices(batch, "text", 4 << 20):
                ids, offsets = word_ids(texts.to_pylist())
                raw = [ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), batch.column("y").slice(first, len(texts)), pa.array(raw, pa.binary())], ["doc_id", "y", "ids"])

    rows = within_bytes(chosen.select("doc_id", "y", "text").mapInArrow(freed(run), "doc_id long, y int, ids binary"), "ids", max_bytes)
    rows = rows.sort_values(["doc_id", "ids"], ignore_index=True)
    y = rows["y"].to_numpy(np.float32)
    got = np.array([(y == 0).sum(), (y == 1).sum()])
    weight = np.array([n.get(0, 0), n.get(1, 0)]) / np.maximum(got, 1)

    def part():
        own = rows["ids"]
        size = np.array([len(x) // (4 + 4 * len(PREFIXES)) for x in own], np.int64)
        return np.frombuffer(b"".join(own), np.int32).reshape(-1, 1 + len(PREFIXES)), np.concatenate([[0], np.cumsum(size)]), y

    model = Cnn(*part(), weight if got.all() else np.ones(2))
    if model.constant is None:
        sent = docs.sparkSession.sparkContext.broadcast((model, langs))

        def count(batches):
            import pyarrow as pa

            model, langs = sent.value
            names = [*langs.langs, "und"]
            for batch in batches:
                for first, texts in slices(batch, "text", 1 << 20):
                    texts = texts.to_pylist()
                    bins = np.floor(np.clip(model.logits(*word_ids(texts)), -MOST, MOST) * BINS).astype(np.int32)
                    best, _ = langs.score(texts)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array([names[k] for k in best], pa.string()), pa.array(bins)], ["doc_id", "lang", "bin"])

        found = cols.select("doc_id", "text").mapInArrow(freed(count), "doc_id long, lang string, bin int")
        found = found.join(own.filter("aside OR NOT drawn").select("doc_id", "y"), "doc_id")
        counts = found.groupBy("lang", "bin", "y").agg(F.count("*").alias("n")).toPandas()
        model.calibrate(counts.sort_values(["lang", "bin", "y"], ignore_index=True), n)
    return model, langs


def score(docs: DataFrame, model: Cnn, langs: langid.Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every document."""
    known = docs.sparkSession.sparkContext.broadcast((model, langs))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, texts in slices(batch, "text", 1 << 20):
                found = known.value[0].score(texts.to_pylist(), known.value[1])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(found)], ["doc_id", "score"])

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(freed(run), "doc_id long, score double")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    found = score(docs, *fit(docs, labels.filter(~held)))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
