"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts letter bigrams and trigrams (everything else counts as one blank) of labelled
documents, hashed into a fixed number of buckets. Documents are drawn by a hash of their id, about
``per_lang`` of each language at most, and every language is learnt; counts, which are summed by
Spark, and model hold only the buckets that a language has. Scoring broadcasts the log
probabilities and sums its rows over the n-grams of a batch of whole texts; language, source
and doc_id are never read for it.

Nulls and edge cases: a null text or one without a letter gives ``und`` and score 0; rows with a
null language or doc_id are never learnt from; ties go to the language that sorts first;
repeated rows are scored alike; with nothing to learn from, every text gives ``und``; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import freed, slices, table
from tesserine.llm.textnum import codes, letters, remainder

BUCKETS = 1 << 15
PER_LANG = 5_000
#: Languages that a counting task holds at once, and cells of texts by languages scored at once.
HELD, CELLS = 64, 1 << 22


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each bigram, bucket of each trigram, offsets of the texts). Both lists have an
    entry for each code point; those of blanks alone, or that reach into the next text, are
    bucket 0, which counts for nothing."""
    flat, bounds = codes([t.lower() for t in texts])
    flat = np.where(letters()[flat], flat, 0)
    pad = np.concatenate([flat, [0, 0]]).astype(np.uint64)
    a, b, c = pad[:-2], pad[1:-1], pad[2:].copy()
    last = bounds[1:] - 1  # every text ends in a blank
    c[last[last > bounds[:-1]] - 1] = 0  # so that no trigram reaches into the next text
    two = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two + c * np.uint64(0x165667B19E3779F9) + np.uint64(0x27D4EB2F165667C5)
    shift = np.uint64(64 - 15)
    two = ((two ^ (two >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> shift).astype(np.int32)
    three = ((three ^ (three >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> shift).astype(np.int32)
    none = (flat == 0) & (b == 0)
    two[none] = 0
    three[none & (c == 0)] = 0
    two[last] = 0
    three[last] = 0
    return two, three, bounds


class Model:
    """Languages in order, and for each the log probabilities of its buckets (float32) and that of all others."""

    def __init__(self, langs: list[str], counts):
        """``counts``: languages by buckets, or a list of each language's (buckets, counts)."""
        self.langs, self.rows = langs, []
        for own in counts:
            at, n = own if isinstance(own, tuple) else (np.flatnonzero(own), own[own != 0])
            whole = n.sum() + 0.5 * BUCKETS
            self.rows.append((at.astype(np.int32), np.log((n + 0.5) / whole).astype(np.float32), np.float32(np.log(0.5 / whole))))

    def row(self, k: int) -> np.ndarray:
        at, logs, other = self.rows[k]
        out = np.full(BUCKETS, other, np.float32)
        out[at] = logs
        out[0] = 0
        return out

    @property
    def logs(self) -> np.ndarray:
        return np.stack([self.row(k) for k in range(len(self.langs))]) if self.langs else np.zeros((0, BUCKETS), np.float32)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(language index or -1, score) of whole texts."""
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        if not len(texts) or not self.langs:
            return best, score
        if len(texts) > 1 and len(texts) * len(self.langs) > CELLS:
            half = len(texts) // 2
            return tuple(np.concatenate(x) for x in zip(self.score(texts[:half]), self.score(texts[half:]), strict=True))
        two, three, bounds = grams(texts)
        used = np.add.reduceat(two != 0, bounds[:-1], dtype=np.int64) + np.add.reduceat(three != 0, bounds[:-1], dtype=np.int64)
        total = np.empty((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            logs = self.row(k)
            total[:, k] = np.add.reduceat(logs[two] + logs[three], bounds[:-1], dtype=np.float64)
        has = used > 0
        total -= total.max(axis=1, keepdims=True)
        chance = np.exp(total)
        chance /= chance.sum(axis=1, keepdims=True)
        best[has] = chance.argmax(axis=1)[has]
        score[has] = chance.max(axis=1)[has]
        return best, score


def draw(rows: DataFrame, per_lang: int) -> tuple[list[str], DataFrame]:
    """The languages of ``rows`` (doc_id, lang and others, without nulls), and about ``per_lang`` rows of each."""
    sizes = rows.groupBy("lang").count().collect()
    if not sizes:
        return [], rows
    buckets = 1 << 20
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(buckets, -(-per_lang * buckets // r["count"])))])[F.col("lang")]
    return sorted(r["lang"] for r in sizes), rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(buckets)) < share)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        per_lang: int = PER_LANG) -> Model:
    """Learn from all rows given that have an id and a language."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    own = own.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    langs, drawn = draw(own, per_lang)
    if not langs:
        return Model([], np.zeros((0, BUCKETS)))

    def count(batches):
        import pyarrow as pa

        place = {x: k for k, x in enumerate(langs)}
        held: dict[int, np.ndarray] = {}

        def flush():
            for k, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            of = [place[x] for x in batch.column("lang").to_pylist()]
            for first, texts in slices(batch, "text"):
                two, three, bounds = grams(texts.to_pylist())
                for k, a, b in zip(of[first : first + len(texts)], bounds[:-1], bounds[1:], strict=True):
                    if k not in held:
                        if len(held) >= HELD:
                            yield from flush()
                        held[k] = np.zeros(BUCKETS, np.int64)
                    for x in (two, three):
                        held[k] += np.bincount(x[a:b], minlength=BUCKETS)
        yield from flush()

    rows = drawn.mapInArrow(freed(count), "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    rows = rows[rows["bucket"] > 0].sort_values(["lang", "bucket"])
    ends = np.searchsorted(rows["lang"].to_numpy(), np.arange(len(langs) + 1))
    at, n = rows["bucket"].to_numpy(np.int64), rows["n"].to_numpy(float)
    return Model(langs, [(at[a:b], n[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        names = [*known.value.langs, "und"]
        for batch in batches:
            for first, texts in slices(batch, "text", 4 << 20):
                best, score = known.value.score(texts.to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array([names[k] for k in best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(freed(run), "doc_id long, lang_pred string, score double")


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    found = identify(docs, fit(docs.filter(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
