import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserine.llm import topk

ROWS = [
    (0, [0.5, -0.25, 1.0]), (20, [0.5, -0.25, 1.0]), (40, [0.0, 0.0, 0.0]), (3, [1.0, 1.0]), (4, [-1.0, 2.0, 0.5]), (60, None),
    (5, []), (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]), (80, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (20, [0.1, 0.1, 0.1]), (9, [0.01, -0.01, 0.0]),
]


def brute(rows, k=20):
    ok = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    dims = max((len(v) for _, v in ok), default=0)
    ok = [(i, np.pad(v, (0, dims - len(v)))) for i, v in ok]
    out = []
    for own, (q, v) in enumerate(ok):
        if q % 20 == 0:
            best = sorted((-int(v @ w), c) for row, (c, w) in enumerate(ok) if row != own)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


def test_edges(spark):
    frame = spark.createDataFrame([(*r, "x") for r in ROWS], "vec_id long, embedding array<float>, score string")
    for blocks in ({}, {"candidates": 3, "query_rows": 2}):
        v = topk.quantised(frame)
        found = topk.search(v, v.filter("vec_id % 20 = 0"), k=3, **blocks).select("query_id", "rank", "vec_id", "score")
        assert sorted(map(tuple, found.collect())) == brute(ROWS, 3)
    empty = topk.quantised(frame.limit(0))
    assert topk.search(empty, empty).collect() == []


def test_large_components(spark):
    """Exact where doubles are not; an error, and no wrong number, where no long holds the score."""
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**9, 0.5]), (2, [2.0**9, 1.0]), (3, [-(2.0**9), 0.25])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = topk.search(v, v.filter("vec_id = 0")).select("vec_id", "score").collect()
    assert [tuple(r) for r in found] == [(2, (1 << 61) + 4096), (1, (1 << 61) + 2048), (3, -(1 << 61) + 1024)]
    far = topk.quantised(spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="does not fit a long"):
        topk.search(far, far.filter("vec_id = 0")).collect()


def test_bound_stops_early(spark):
    """A query along one axis scores few of many candidates."""
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(1, 9, (2000, 1)), rng.integers(0, 2, (2000, 7))], axis=1)
    lists = topk.Lists(np.arange(2000), np.arange(2000), v.astype(float))
    ids, score, scored = lists.top(np.array([50.0, 1, 0, 0, 0, 0, 0, 0]), 0, 5)
    want = sorted((-int(x @ [50, 1, 0, 0, 0, 0, 0, 0]), i) for i, x in enumerate(v) if i)[:5]
    assert [(-int(s), int(i)) for i, s in zip(ids, score)] == want and scored < 1500


def test_whole_table(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.sql(topk.ORACLE_SQL["op6_threshold_topk"]).fetchall()
    assert sorted(map(tuple, topk.op6_topk(spark, sf).collect())) == sorted(want)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 60), st.integers(1, 5), st.integers(1, 8), st.integers(0, 10_000))
def test_walk_is_exact(n, dims, k, seed):
    rng = np.random.default_rng(seed)
    v, ids = rng.integers(-3, 4, (n, dims)), rng.permutation(200)[:n]
    lists, q = topk.Lists(ids, ids, v.astype(float)), rng.integers(-3, 4, dims)
    own = int(ids[0])
    found, score, _ = lists.top(q, own, k)
    want = sorted((-int(v[i] @ q), int(ids[i])) for i in range(n) if ids[i] != own)[:k]
    assert [(-int(s), int(i)) for i, s in zip(found, score, strict=True)] == want
