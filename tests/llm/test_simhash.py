import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.llm import simhash
from tesserine.llm.common import table
from tests.llm.helpers import docs


def plain_fingerprint(text):
    import re

    from xxhash import xxh64_intdigest

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hs = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, bits=2):
    """doc_id -> least doc_id reachable, from (doc_id, fingerprint)."""
    fps = np.array(sorted({f for _, f in rows}), np.uint64)
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= bits
    while True:
        new = np.where(near, label[None], len(fps)).min(axis=1)
        if (new == label).all():
            break
        label = new
    comp = dict(zip(fps.tolist(), label.tolist(), strict=True))
    least = {}
    for d, f in rows:
        if d is not None:
            least[comp[f]] = min(d, least.get(comp[f], d))
    return sorted(((d, f, least.get(comp[f])) for d, f in rows), key=str)


def got(frame):
    return sorted(((r.doc_id, int(r.fp) & (1 << 64) - 1, r.component_id) for r in frame.collect()), key=str)


def test_edges(spark):
    frame = docs(spark)
    want = brute([(r.doc_id, plain_fingerprint(r.text)) for r in frame.collect()])
    assert got(simhash.near_duplicates(frame)) == want
    assert simhash.near_duplicates(frame.limit(0)).collect() == []


def test_whole_table(spark, sf):
    frame = table(spark, sf, "documents")
    want = brute([(r.doc_id, plain_fingerprint(r.text)) for r in frame.collect()])
    assert got(simhash.near_duplicates(frame, leaf_points=20)) == want


@pytest.mark.parametrize("dense,tree", [(40_000, {}), (100, {}), (60, {"tree_sample": 400}), (10, {"tree_sample": 100})])
def test_planted_balls(spark, dense, tree):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    flips = lambda x, k: x ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (len(x), k)).astype(np.uint64), axis=1)
    ball = flips(np.repeat(base[:1], 500), 3)
    fps = np.concatenate([base, flips(base[:200], 2), flips(base[100:250], 3), ball, base[:50]])
    rows = [(int(i), int(f)) for i, f in enumerate(fps)]
    frame = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in rows], "doc_id long, fp long")
    found = frame.join(simhash.near_groups(frame, leaf_points=40, dense=dense, **tree), "fp")
    assert got(found) == brute(rows)


def test_components_of_long_chains(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = simhash.components(edges.union(edges.selectExpr("a + 1000", "b + 1000"))).collect()
    assert sorted((r.a, r.b) for r in found) == [(k, 0) for k in range(1, 301)] + [(k + 1000, 1000) for k in range(1, 301)]


def test_scattered_points_are_divided_and_not_a_ball(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    fps = np.concatenate([base, base[:600] ^ np.uint64(5), base[300:900] ^ np.uint64(1 << 40)])
    rows = [(int(i), int(f)) for i, f in enumerate(fps)]
    frame = spark.createDataFrame(rows, "doc_id long, fp long")
    distinct = frame.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    done, balls, _ = simhash.leaves(distinct, 2, leaf_points=20, tree_sample=65_536, dense=400)
    assert not balls
    assert all(r.n * r.homes <= 400**2 for x in done for r in x.groupBy("leaf").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).collect())
    assert sum(x.filter("home").count() for x in done) == len(np.unique(fps))
    assert got(frame.join(simhash.near_groups(frame, leaf_points=20, dense=400), "fp")) == brute(rows)


def test_near_pairs_meet_at_a_home():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(1 << 7), base ^ np.uint64(3 << 20)]))
    i, leaf, home = simhash.assign(simhash.build_tree(fps, 40, 2), fps, 2)
    at, homes = [set() for _ in fps], {int(k): int(x) for k, x in zip(i[home], leaf[home], strict=True)}
    for k, x in zip(i.tolist(), leaf.tolist(), strict=True):
        at[k].add(x)
    a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 2, 1))
    assert len(a) >= 4000 and all(homes[int(y)] in at[x] or homes[int(x)] in at[y] for x, y in zip(a.tolist(), b.tolist(), strict=True))
