"""Exact top-k inner products by the threshold algorithm over sorted lists of dimensions.

Vectors are dealt into blocks by a hash of their row, and so are the queries; every block of queries
meets every block of candidates in one task. There each dimension is a list of the candidates in
the order of their components. A query walks all lists from the end that its own component
favours, some steps at a time; every candidate that it meets is scored in full, and the walk
stops once all have been met, or once the bound (the sum of what the lists still hold at this depth) is below the k-th
best score, since no candidate that was not met can then enter the result, ties included. The k
best of each block are then merged for each query.

A block pair reads ``candidates`` rows against ``queries`` rows, whatever the size of the
table, and gives k rows a query at most.

How much the bound saves depends on the vectors. Where they point in all directions alike, as random
ones do in 64 dimensions, the lists have shown every candidate before the bound falls below the k-th
score; ``scored`` tells for each result how many candidates its query scored in full.

Nulls and edge cases: vectors that are null, empty, or hold null or non-finite components take no
part, nor do rows with a null id; a shorter vector counts as filled up with zeros; rows with equal ids
are queries and candidates each, and candidates of each other; fewer than k candidates give them all;
ties go to the smaller id; components are whole numbers of any size, and a score that no long holds
raises an OverflowError; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserine.llm.common import freed_group, scratch, table

CANDIDATES, QUERIES = 1 << 14, 1 << 9


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """place (one a row), vec_id and floor(scale * component), as doubles, of the vectors that take part.
    Written, so that places stay."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = own.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite)
    whole = lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)
    own = own.select(F.monotonically_increasing_id().alias("place"), "vec_id", F.transform("v", lambda x: whole(x * F.lit(scale))).alias("v"))
    return scratch(own, "vectors")


class Lists:
    """The sorted lists of one block of candidates."""

    def __init__(self, ids: np.ndarray, places: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")  # equal scores then come in the order of ids
        self.ids, self.places, self.vectors = ids[order], places[order], vectors[order]
        if vectors.dtype == object:  # beyond what doubles hold exactly
            return
        self.rise = np.ascontiguousarray(np.argsort(self.vectors, axis=0, kind="stable").T.astype(np.int32))
        self.sorted = np.ascontiguousarray(np.sort(self.vectors, axis=0).T)

    def top(self, query: np.ndarray, own: int, k: int, step: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores, number scored) of the k best candidates for one query but the row at place ``own``,
        best first."""
        n = len(self.ids)
        dims = np.flatnonzero(query)
        if self.vectors.dtype == object:
            score = [sum(a * b for a, b in zip(v, query, strict=True)) for v in self.vectors.tolist()]
            order = sorted(np.flatnonzero(self.places != own).tolist(), key=lambda i: -score[i])[:k]
            if any(abs(score[i]) >> 63 for i in order):
                raise OverflowError("a score does not fit a long")
            return self.ids[order], np.array([score[i] for i in order], np.int64), n
        if not len(dims):  # every score is zero: the smallest ids
            keep = np.flatnonzero(self.places != own)[:k]
            return self.ids[keep], np.zeros(len(keep), self.vectors.dtype), 0
        weight = query[dims]
        up = weight > 0
        met = self.places == own
        best, score, depth = np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype), 0
        total = left = n - int(met.sum())
        while left:
            stop = min(n, depth + step)
            fresh = np.zeros(n, bool)
            fresh[self.rise[dims[~up], depth:stop]] = True
            fresh[self.rise[dims[up], n - stop : n - depth]] = True
            fresh &= ~met
            new = np.flatnonzero(fresh)
            met |= fresh
            left -= len(new)
            if len(new):
                best, score = np.concatenate([best, new]), np.concatenate([score, self.vectors[new] @ query])
                if len(best) > k:
                    kth = np.partition(score, len(score) - k)[len(score) - k]
                    keep = score >= kth
                    best, score = best[keep], score[keep]
            bound = np.where(up, self.sorted[dims, n - stop], self.sorted[dims, stop - 1]) @ weight
            if len(best) >= k and bound < score.min():
                break
            depth, step = stop, step * 2
        order = np.lexsort((best, -score))[:k]
        return self.ids[best[order]], score[order], total - left


def _matrix(column, dims: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    values = np.asarray(column.values if hasattr(column, "values") else column.combine_chunks().values)
    size = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(size), dims))
    rows = np.repeat(np.arange(len(size)), size)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which their inner products are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        kind = np.float32 if most < 1 << 24 else np.float64
        return a.astype(kind), b.astype(kind)
    whole = np.vectorize(int, otypes=[object])
    return whole(a), whole(b)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, candidates: int = CANDIDATES, query_rows: int = QUERIES) -> DataFrame:
    """place, query_id, rank, vec_id, score and scored of each query's k best; both frames hold place,
    vec_id and v, and the row of a query's place is no candidate for it."""
    n, m = vectors.count(), queries.count()
    c_blocks, q_blocks = max(1, -(-n // candidates)), max(1, -(-m // query_rows))
    block = lambda b: F.pmod(F.xxhash64("place"), F.lit(b))
    every = lambda b: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(b - 1).cast("long")))
    left = vectors.withColumn("c", block(c_blocks)).withColumn("q", every(q_blocks))
    asks = queries.select(F.col("place").alias("own"), F.col("vec_id").alias("query_id"), F.col("v").alias("w"), block(q_blocks).alias("q"))
    right = asks.withColumn("c", every(c_blocks))

    def meet(a, b):
        import pyarrow as pa

        out = {"place": [], "query_id": [], "vec_id": [], "score": [], "scored": []}
        if a.num_rows and b.num_rows:
            va, vb = a.column("v").combine_chunks(), b.column("w").combine_chunks()
            dims = int(max(np.diff(np.asarray(va.offsets)).max(), np.diff(np.asarray(vb.offsets)).max()))
            own, asked = _exact(_matrix(va, dims), _matrix(vb, dims))
            ids, places = (np.asarray(a.column(x).combine_chunks()) for x in ("vec_id", "place"))
            lists = Lists(ids, places, own)
            for place, query_id, q in zip(b.column("own").to_pylist(), b.column("query_id").to_pylist(), asked, strict=True):
                ids, score, scored = lists.top(q, place, k)
                for name, x in (("place", place), ("query_id", query_id), ("scored", scored)):
                    out[name].append(np.full(len(ids), x))
                out["vec_id"].append(ids)
                out["score"].append(score)
        return pa.table({c: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)) for c, x in out.items()})

    found = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInArrow(freed_group(meet), "place long, query_id long, vec_id long, score long, scored long")
    own = Window.partitionBy("place")
    ranked = found.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("place", "query_id", "rank", "vec_id", "score", "scored")


def op6_topk(spark, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.filter("vec_id % 20 = 0")).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = {
    "op6_threshold_topk": """
WITH v AS (SELECT row_number() OVER () rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.rid, q.vec_id query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) score
  FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) "rank" FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 20
"""
}
