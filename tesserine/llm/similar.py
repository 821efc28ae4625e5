"""Near copies by the Jaccard similarity of their word shingles, ``least`` or more.

1. Every text gives the set of its shingles' 64-bit hashes, and of that ``BANDS`` keys of ``PER_BAND``
   MinHash values each. Two texts of similarity 0.8 share a key with probability 0.99995, more similar
   ones with more.
2. Texts that share a key are candidates: all pairs under a key of at most ``small`` texts; under a key
   of more, at first each text with up to ``PIVOTS`` texts of that key, so that pairs grow with the texts.
3. Candidates are checked on the whole sets. First each text's pair with its least partner, then
   every other pair whose texts the first links have not joined already.
4. A key of more than ``small`` texts that still holds several components: each text outside its largest
   component meets every text of another component, in cells of about ``CHUNK`` by ``BLOCK`` shingles. Whole
   sets are compared there, of texts that agree in nearly as many MinHash values as ``least`` demands (a pair
   of that similarity fails to with a probability below 1e-7), and only links leave a cell, one for each
   text and component.
5. Connected components of the links; the row with the least id of each stays.

Nulls and edge cases: a text without words, empty or null, is like no other and stays; fewer words than a
shingle make one shingle; a null id is the least of a component only where there is no other; repeated rows
are copies; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import drop_scratch, freed, row_of, scratch, slices, with_row
from tesserine.llm.simhash import components

SEED = 42
BANDS, PER_BAND = 25, 5
PIVOTS = 8
#: Shingles of a cell: of the texts outside the key's largest component, and of all its texts.
CHUNK, BLOCK = 1 << 18, 1 << 20


class _Hashes(dict):
    """XXH64 of words."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        out = self[word] = xxh64_intdigest(word, SEED)
        return out


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: A-Z lowered, ASCII white space between words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(_hashes) > 200_000:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    wide = min(shingle, len(h))
    if not wide:
        return h
    out = np.full(len(h) - wide + 1, wide, np.uint64)
    for k in range(wide):
        out = _mix(out) + h[k : k + len(out)]
    return np.unique(_mix(out))


def band_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each set a row of BANDS keys, and a byte of each MinHash value; no set may be empty."""
    rng = np.random.default_rng(11)
    masks = rng.integers(0, 1 << 64, BANDS * PER_BAND, dtype=np.uint64)
    odds = rng.integers(0, 1 << 64, BANDS * PER_BAND, dtype=np.uint64) | np.uint64(1)
    out, marks = np.empty((len(sets), BANDS), np.uint64), np.empty((len(sets), BANDS * PER_BAND), np.uint8)
    if not sets:
        return out, marks
    size = np.array([len(s) for s in sets])
    flat, first = np.concatenate(sets), np.cumsum(size) - size
    for band in range(BANDS):
        key = np.full(len(sets), band, np.uint64)
        for k in range(band * PER_BAND, (band + 1) * PER_BAND):
            low = np.minimum.reduceat((flat ^ masks[k]) * odds[k], first)
            key, marks[:, k] = _mix(key) + low, _mix(low) >> np.uint64(56)
        out[:, band] = _mix(key)
    return out, marks


def _keyed(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id, keys and marks (none without words), n (size of the set) and row of every document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, texts in slices(batch, "text", 2 << 20):
                sets = [shingles(t, shingle) for t in texts.to_pylist()]
                n = np.array([len(s) for s in sets], np.int64)
                keys, marks = band_keys([s for s in sets if len(s)])
                keys, marks = keys.ravel().view(np.int64), iter(marks)
                ends = np.concatenate([[0], np.cumsum((n > 0) * BANDS)]).astype(np.int32)
                marks = pa.array([next(marks).tobytes() if k else None for k in n], pa.binary())
                own = [batch.column(c).slice(first, len(texts)) for c in ("doc_id", "row")]
                yield pa.RecordBatch.from_arrays([own[0], pa.ListArray.from_arrays(ends, pa.array(keys)), marks, pa.array(n), own[1]], ["doc_id", "keys", "marks", "n", "row"])

    keep = tuple(docs.columns)
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *row_of(docs, keep))
    return cols.mapInArrow(freed(run), with_row("doc_id long, keys array<long>, marks binary, n long", docs, keep))


def _candidates(rows: DataFrame, small: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b) of places, a < b, that share a key and whose sizes allow ``least``; and
    place, n, key and m of each text under a key of m > 1 texts."""
    bands = scratch(rows.select("place", "n", F.explode("keys").alias("key")), "bands")
    sizes = bands.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    shared = scratch(bands.join(sizes, "key"), "shared")
    drop_scratch(bands)
    few, many = shared.filter(F.col("m") <= small), shared.filter(F.col("m") > small)
    salt = F.pmod(F.xxhash64("place", F.lit("pivot")), F.lit(PIVOTS))
    pivots = many.groupBy("key", salt.alias("salt")).agg(F.min(F.struct("place", "n")).alias("p")).select("key", F.col("p.place").alias("other"), F.col("p.n").alias("m2"))
    others = few.select("key", F.col("place").alias("other"), F.col("n").alias("m2"))
    both = few.join(others, "key").filter("place > other").unionByName(many.join(pivots, "key").filter("place <> other"))
    both = both.filter(F.least("n", "m2") >= F.lit(least - 1e-9) * F.greatest("n", "m2"))
    return scratch(both.selectExpr("least(place, other) a", "greatest(place, other) b").distinct(), "candidates"), shared


def _apart(many: DataFrame, marks: DataFrame, roots: DataFrame, least: float, sets_of) -> DataFrame:
    """Links (a, b), a < b, of similarity ``least`` between texts of different components that share a key: of
    each text at least one to every component that it is so linked to. ``many``: place, n and key;
    ``roots``: components(); ``sets_of``: the sets of a table's places."""
    many = many.join(roots.select(F.col("a").alias("place"), F.col("b").alias("root")), "place", "left")
    many = many.withColumn("root", F.coalesce("root", "place"))
    held = many.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    held = held.groupBy("key").agg(F.max(F.struct("c", "root", "w")).alias("top"), F.sum("c").alias("m"), F.sum("w").alias("w"))
    held = held.filter("m > top.c").selectExpr("key", "top.root home", f"ceil((w - top.w) / {CHUNK}) chunks", f"ceil(w / {BLOCK}) blocks")
    own = scratch(many.join(held, "key"), "apart")
    sets = sets_of(own.select("place").distinct())
    full = own.join(marks, "place").join(sets, "place")
    at = {c: F.pmod(F.xxhash64("place", F.lit(c)), F.col(f"{c}s")) for c in ("chunk", "block")}
    every = {c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{c}s") - 1)) for c in at}
    cols = ["key", "place", "n", "root", "marks", "hashes"]
    odd = full.filter("root <> home").select(*cols, F.lit(True).alias("odd"), at["chunk"].alias("chunk"), every["block"].alias("block"))
    rest = full.select(*cols, F.lit(False).alias("odd"), every["chunk"].alias("chunk"), at["block"].alias("block"))
    wide = BANDS * PER_BAND
    agree = int(wide * least - 5.5 * (wide * least * (1 - least)) ** 0.5)

    def run(cell):
        import pyarrow as pa

        odd = cell.column("odd").to_numpy()
        marks = np.frombuffer(b"".join(cell.column("marks").to_pylist()), np.uint8).reshape(-1, wide)
        place, n, root = (cell.column(c).to_numpy() for c in ("place", "n", "root"))
        hashes = [np.frombuffer(x, np.uint64) for x in cell.column("hashes").to_pylist()]
        side = np.flatnonzero(~odd)
        size, whose, others = n[side], root[side], marks[side]
        a, b = [], []
        for k in np.flatnonzero(odd):
            fit = (whose != root[k]) & (np.minimum(size, n[k]) >= (least - 1e-9) * np.maximum(size, n[k]))
            joined = set()
            for other in side[fit][(others[fit] == marks[k]).sum(axis=1) >= agree]:
                if root[other] in joined:
                    continue
                both = len(np.intersect1d(hashes[k], hashes[other], assume_unique=True))
                if both >= (least - 1e-9) * (n[k] + n[other] - both):
                    joined.add(root[other])
                    a.append(min(place[k], place[other]))
                    b.append(max(place[k], place[other]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = odd.unionByName(rest).groupBy("key", "chunk", "block").applyInArrow(run, "a long, b long")
    out = scratch(found, "late")
    drop_scratch(own, sets)
    return out


def _linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs of similarity ``least`` or more. ``sets``: place and the hashes as bytes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= (least - 1e-9) * (len(x) + len(y) - both))
            own = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"])
            yield own.filter(pa.array(keep, pa.bool_()))

    x, y = (sets.select(F.col("place").alias(p), F.col("hashes").alias(h)) for p, h in (("a", "x"), ("b", "y")))
    return scratch(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(freed(run), "a long, b long"), "near")


def one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8,
                   small: int = 16) -> DataFrame:
    """The rows of ``docs`` but for near copies: of each component the one with the least id stays."""
    rows = scratch(_keyed(docs, id_col, text_col, shingle).withColumn("place", F.monotonically_increasing_id()), "rows")
    pairs, shared = _candidates(rows.select("place", "n", "keys"), small, least)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, texts in slices(batch, "text", 2 << 20):
                raw = [shingles(t, shingle).tobytes() for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("place").slice(first, len(texts)), pa.array(raw, pa.binary())], ["place", "hashes"])

    def sets_of(places):
        wanted = scratch(places, "wanted")
        texts = rows.select("place", F.col("row")[text_col].cast("string").alias("text")).join(wanted, "place")
        out = scratch(texts.mapInArrow(freed(run), "place long, hashes binary"), "sets")
        drop_scratch(wanted)
        return out

    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("place")).distinct())
    first = _linked(pairs.groupBy("b").agg(F.min("a").alias("a")), sets, least)
    roots = components(first)
    rooted = pairs
    for side in ("a", "b"):
        own = roots.select(F.col("a").alias(side), F.col("b").alias(f"root_{side}"))
        rooted = rooted.join(own, side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    more = _linked(rooted.filter("root_a <> root_b").select("a", "b"), sets, least)
    drop_scratch(sets, pairs, roots)
    links = first.unionByName(more)
    roots = components(links)
    late = _apart(shared.filter(F.col("m") > small).select("place", "n", "key"), rows.select("place", "marks"), roots, least, sets_of)
    drop_scratch(shared)
    if not late.isEmpty():
        drop_scratch(roots)
        roots = components(links.unionByName(late))
    drop_scratch(first, more, late)
    member = roots.selectExpr("a place", "b root").union(roots.selectExpr("b place", "b root").distinct())
    member = scratch(member.join(rows.select("place", "doc_id"), "place"), "members")
    best = member.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("place"))).alias("best"))
    gone = scratch(member.join(best, "root").filter("place <> best.place").select("place"), "gone")
    return rows.join(gone, "place", "left_anti").select("row.*")
