import re

import numpy as np
import pytest

import corpus_pipeline as P
from tesserine.llm import similar
from tests.llm.helpers import docs


def plain_shingles(text, k=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def brute(rows, least=0.8):
    """Least id of every component of (id, text)."""
    sets = [plain_shingles(t) for _, t in rows]
    label = [i for i, _ in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if jaccard(sets[a], sets[b]) >= least]
    for _ in rows:
        old = list(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if old == label:
            break
    return sorted(set(label))


def copies(seed=4, bases=40):
    """(id, text): texts, each with a copy of which some words are others; similarity about 0.6 to 1."""
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    out = []
    for k in range(bases):
        own = word(int(rng.integers(60, 300)))
        other = list(own)
        for at in rng.choice(len(own), max(1, len(own) * (k % 8) // 160), replace=False):
            other[at] = "changed"
        out += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
    return out


def test_shingles_are_the_plain_sets():
    a, b = copies()[6][1], copies()[7][1]
    x, y = similar.shingles(a), similar.shingles(b)
    assert len(x) == len(plain_shingles(a))
    assert len(np.intersect1d(x, y)) == len(plain_shingles(a) & plain_shingles(b))


def test_stage_finds_planted_copies(spark, sf):
    rows = copies()
    near = [jaccard(plain_shingles(a[1]), plain_shingles(b[1])) for a, b in zip(rows[::2], rows[1::2], strict=True)]
    assert sum(0.8 <= j < 0.95 for j in near) >= 10 and sum(j < 0.8 for j in near) >= 5
    stage = dict(P.STAGES)["near_duplicates"]
    found = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert sorted(r.doc_id for r in found.collect()) == brute(rows)


def test_whole_table(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    found = similar.one_of_similar(frame)
    assert found.columns == frame.columns
    assert sorted(r.doc_id for r in found.collect()) == brute(rows)


@pytest.mark.parametrize("small", [1, 16])
def test_one_large_group(spark, small):
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    rows = []
    for k in range(60):
        own = list(base)
        own[int(rng.integers(0, 200))] = f"new{k}"
        rows.append((k, " ".join(own)))
    rows += [(100 + k, " ".join(f"v{x}" for x in rng.integers(0, 5000, 50))) for k in range(20)]
    found = similar.one_of_similar(spark.createDataFrame(rows, "doc_id long, text string"), small=small)
    assert sorted(r.doc_id for r in found.collect()) == brute(rows)


@pytest.mark.parametrize("chunk, block", [(1 << 18, 1 << 20), (600, 1000)])
def test_chain_under_large_keys(spark, monkeypatch, chunk, block):
    """Each text is like its neighbours only, and few are like a pivot."""
    monkeypatch.setattr(similar, "PIVOTS", 1)
    monkeypatch.setattr(similar, "CHUNK", chunk)
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = []
    for base in range(2):
        long = [f"w{x}" for x in rng.integers(0, 50_000, 700)]
        rows += [(100 * base + k, " ".join(long[8 * k : 8 * k + 200])) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = similar.one_of_similar(frame, small=1)
    assert sorted(r.doc_id for r in found.collect()) == brute(rows) == [0, 100]


def test_edges(spark):
    found = [r.doc_id for r in similar.one_of_similar(docs(spark)).collect()]
    assert sorted(found, key=str) == sorted([1, 2, 3, 4, 5, 6, None, 8], key=str)
    assert similar.one_of_similar(docs(spark).limit(0)).collect() == []
