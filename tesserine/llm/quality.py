"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of 64 words. Each passage is described by shares of character
classes, word lengths, repetition and a hashed histogram of word shapes, and encoded by one hidden
layer. Gated attention (tanh times sigmoid) weighs the passages, and the weighted mean of their
codes gives the score. Everything is learnt from labels of whole documents, in numpy, on at most
``max_train`` labelled documents drawn by a hash of their id; their passages' features are
computed by Spark and only those reach the driver, ``max_bytes`` of them at most. Scoring reads whole texts in batches.

Nulls and edge cases: a null or empty text is one passage of zeros and is scored like any other;
rows without a label or doc_id are not learnt from; a document with several labels counts as good if
any says so; with labels of one class only, every document scores that class's share; repeated rows
score alike; an empty table gives no rows; language, source and doc_id are never features.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import WS_CHARS, freed, row_of, slices, table, with_row
from tesserine.llm.textnum import bounded, codes, letters, mix, remainder, within_bytes, word_hashes, words

PASSAGE = 64
SHAPES = 32
#: Signs that are classes of their own; 0 to 5 are lower case, upper case, digit, blank, other sign, other.
SIGNS = "\n.,!?|#*$%&<>@"
CLASSES = 6 + len(SIGNS)
FEATURES = CLASSES + 7 + SHAPES
MAX_TRAIN = 10_000
#: Bytes of passages' features that reach the driver.
MAX_BYTES = 64 << 20
HIDDEN, GATE = 24, 12


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point."""
    out = np.full(0x110000, 4, np.uint8)
    out[256:] = 5
    out[letters()] = 0
    out[np.fromiter((chr(c).isupper() for c in range(0x110000)), bool, 0x110000)] = 1
    out[48:58] = 2
    out[[32, 9, 11, 12, 13]] = 3
    for k, sign in enumerate(SIGNS):
        out[ord(sign)] = 6 + k
    return out


def _distinct(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values in each of n groups."""
    key = np.sort((group.astype(np.uint64) << np.uint64(42)) | (value >> np.uint64(22)))
    first = np.concatenate([[True], key[1:] != key[:-1]])
    return np.bincount((key[first] >> np.uint64(42)).astype(np.int64), minlength=n)


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features by passage, offsets of the texts' passages); every text has one passage at least."""
    texts = [t.strip(WS_CHARS) for t in texts]
    full = np.flatnonzero([bool(t) for t in texts])
    n_pass = np.ones(len(texts), np.int64)
    if not len(full):
        return np.zeros((len(texts), FEATURES), np.float32), np.arange(len(texts) + 1)
    flat, bounds = codes([texts[k] for k in full])
    start, stop = words(flat)
    doc = np.searchsorted(bounds, start, side="right") - 1
    n_words = np.bincount(doc, minlength=len(full))
    first = np.cumsum(n_words) - n_words
    own = -(-n_words // PASSAGE)
    base = np.cumsum(own) - own
    passage = base[doc] + (np.arange(len(start)) - first[doc]) // PASSAGE
    total = int(own.sum())
    out = np.zeros((total, FEATURES), np.float32)
    kind = classes()[flat]
    gaps = np.diff(np.append(start, len(flat)))
    chars = np.bincount(np.repeat(passage * CLASSES, gaps) + kind, minlength=total * CLASSES).reshape(total, CLASSES)
    out[:, :CLASSES] = chars / chars.sum(axis=1, keepdims=True)
    size = (stop - start).astype(float)
    count = np.bincount(passage, minlength=total)
    mean = np.bincount(passage, size, total) / count
    spread = np.bincount(passage, size * size, total) / count - mean * mean
    hashes = word_hashes(flat, start, stop)
    three = hashes.copy()  # the last two words of a text stand for themselves
    inside = np.flatnonzero(doc[2:] == doc[:-2])
    three[inside] = mix(hashes[inside] + hashes[inside + 1] * np.uint64(3) + hashes[inside + 2] * np.uint64(5))
    col = CLASSES
    owner = np.repeat(np.arange(len(full)), own)
    for value in (
        np.minimum(mean, 50) / 10,
        np.sqrt(np.clip(spread, 0, 2500)) / 10,
        _distinct(passage, hashes, total) / count,
        count / PASSAGE,
        (np.log1p(n_words) / 10)[owner],
        (_distinct(doc, three, len(full)) / np.maximum(n_words, 1))[owner],
        (_distinct(doc, hashes, len(full)) / np.maximum(n_words, 1))[owner],
    ):
        out[:, col] = value
        col += 1
    shape = kind[start].astype(np.uint64) * np.uint64(64) + kind[stop - 1].astype(np.uint64)
    shape = mix(shape * np.uint64(16) + np.minimum(stop - start, 15).astype(np.uint64)) >> np.uint64(59)
    shapes = np.bincount(passage * SHAPES + shape.astype(np.int64), minlength=total * SHAPES).reshape(total, SHAPES)
    out[:, col:] = shapes / count[:, None]
    n_pass[full] = own
    offsets = np.concatenate([[0], np.cumsum(n_pass)])
    if len(full) == len(texts):
        return out, offsets
    spread_out = np.zeros((offsets[-1], FEATURES), np.float32)
    spread_out[np.repeat(offsets[:-1][full], own) + np.arange(total) - base[owner]] = out
    return spread_out, offsets


sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Attention:
    """Gated attention over encoded passages, trained by Adam on the log loss."""

    def __init__(self, x: np.ndarray, offsets: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 4e-3, decay: float = 1e-4):
        rng = np.random.default_rng(11)
        self.constant = None
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        p = self.p = {"W": draw(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1, np.float32)}
        m, v = ({k: np.zeros_like(z) for k, z in p.items()} for _ in range(2))
        step, size = 0, np.diff(offsets)
        for epoch in range(epochs):
            now = rate * (1 - epoch / epochs)
            for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
                n = size[part]
                at = np.repeat(offsets[:-1][part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                grad = self._grad(x[at], np.cumsum(n) - n, n, y[part])
                step += 1
                for k, g in grad.items():
                    g = g + decay * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def _forward(self, x, first, n):
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
        a = e / np.repeat(np.add.reduceat(e, first), n)
        z = np.add.reduceat(a[:, None] * h, first)
        return h, t, g, a, z, z @ p["c"] + p["d"]

    def _grad(self, x, first, n, y):
        p = self.p
        h, t, g, a, z, s = self._forward(x, first, n)
        ds = (sigmoid(s) - y) / len(y)
        dz = np.repeat(ds[:, None] * p["c"], n, axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), n))
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (de[:, None] * t * g).sum(axis=0), "c": ds @ z, "d": ds.sum(keepdims=True)}

    def score(self, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        return sigmoid(self._forward(x, offsets[:-1], np.diff(offsets))[-1]).astype(float)


def labelled(labels: DataFrame, column: str, id_col: str = "doc_id") -> DataFrame:
    """One row (doc_id, y) for each labelled document; 1 if any of its labels is."""
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(column) > 0).cast("int").alias("y"))
    return own.filter("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> Attention:
    """Learn from the labelled documents; the sample of labels is bounded, and so broadcast."""
    drawn = bounded(labelled(labels, label_col), max_train)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, texts in slices(batch, "text", 1 << 20):
                x, offsets = passages(texts.to_pylist())
                raw = [x[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), batch.column("y").slice(first, len(texts)), pa.array(raw, pa.binary())], ["doc_id", "y", "x"])

    rows = within_bytes(own.join(F.broadcast(drawn), "doc_id").mapInArrow(freed(run), "doc_id long, y int, x binary"), "x", max_bytes)
    rows = rows.sort_values(["doc_id", "y", "x"], ignore_index=True)
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, FEATURES)
    size = np.array([len(r) // (4 * FEATURES) for r in rows["x"]], np.int64)
    return Attention(x, np.concatenate([[0], np.cumsum(size)]), rows["y"].to_numpy(np.float32))


def score(docs: DataFrame, model: Attention, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and score of every document; with ``keep``, also a struct ``row`` of these columns."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, texts in slices(batch, "text", 1 << 20):
                found = known.value.score(*passages(texts.to_pylist()))
                rest = [batch.column("row").slice(first, len(texts))] if keep else []
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(found), *rest], ["doc_id", "score"] + ["row"] * len(rest))

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *row_of(docs, keep))
    return cols.mapInArrow(freed(run), with_row("doc_id long, score double", docs, keep))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    found = score(docs, fit(docs, labels.filter(~held)))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
