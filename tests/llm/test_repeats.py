"""Repeated byte strings against brute force, and the merged transforms against sorting."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.llm.repeats import merge, remove_repeats, transform
from tests.llm.helpers import DOCS, docs


def brute(rows, length):
    """doc row -> (kept bytes, removed runs)."""
    first: dict[bytes, int] = {}
    texts = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            first[s] = min(first.get(s, float("inf")), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        runs, k = [], 0
        while k < len(t):
            if gone[k]:
                stop = k
                while stop < len(t) and gone[stop]:
                    stop += 1
                runs.append((k, stop - k))
                k = stop
            else:
                k += 1
        out.append((bytes(b for b, g in zip(t, gone, strict=True) if not g), runs))
    return out


def corpus(n, seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeé\n", k=r.randint(1, 7))) for _ in range(300)]
    passages = [" ".join(r.choices(vocabulary, k=r.randint(8, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        words = r.choices(vocabulary, k=r.randint(0, 120))
        if i % 3 == 0:
            words.insert(r.randint(0, len(words)), r.choice(passages))
        if i % 7 == 0 and rows:
            words = r.choice(rows)[1].split(" ")
            if words and i % 2:
                words[r.randrange(len(words))] = "changed"
        rows.append((r.randint(0, n) if i % 11 == 0 else i, " ".join(words)))
    rows += [(n + 1, "x" * 700), (n + 2, "x" * 300), (n + 3, "ab" * 200), (n + 4, "ab" * 30 + "c" * 60), (None, rows[0][1]), (None, "y" * 80), (None, "y" * 80)]
    rows += [(n + 5, "\0" * 120), (n + 6, "z" + "\0" * 70)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("length", "more"), [(50, {}), (50, {"shard_bytes": 900, "hot": 3, "merge_bytes": 2000}), (37, {"shard_bytes": 5000})])
def test_like_brute_force(spark, length, more):
    rows = corpus(120, length)
    frame = docs(spark, rows).repartition(5)
    found = remove_repeats(frame, length=length, **more).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.kept), [(s.start, s.length) for s in r.spans]) for r in found)
    expect = sorted((i is None, i or 0, k, s) for (i, _), (k, s) in zip(rows, brute(rows, length), strict=True))
    assert got == expect
    assert any(s for *_, s in expect)


def test_edge_cases(spark):
    found = remove_repeats(docs(spark), length=40).select("doc_id", F.octet_length("kept").alias("n"), F.size("spans").alias("spans")).collect()
    assert len(found) == 10
    by_id = {r.doc_id: r for r in found}
    assert by_id[7].n == 0 and by_id[7].spans == 1  # a copy of document 1's text of 49 bytes
    assert by_id[2].n == by_id[3].n == 0 and by_id[2].spans == 0
    assert by_id[5].n == 25_000  # repeats within one document stay
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_on_documents(spark, sf):
    from tesserine.llm.repeats import op4_repeats

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    expect = {i: (len((t or "").encode()), sum(n for _, n in s), len(s), hashlib.sha256(k).hexdigest()) for (i, t), (k, s) in zip(rows, brute(rows, 50), strict=True)}
    found = {r.doc_id: tuple(r)[1:] for r in op4_repeats(spark, sf).collect()}
    assert found == expect


def test_merged_transforms():
    r = np.random.default_rng(3)
    size = r.integers(30, 60, 40)
    flat = r.integers(0, 3, int(size.sum())).astype(np.uint8)
    cuts = [0, 5, 6, 25, 40]
    base = np.cumsum(size) - size
    length = 30
    blocks = np.empty(len(flat), np.int64)
    made = [(int(base[a]), *transform(flat[base[a] : base[b - 1] + size[b - 1]], size[a:b], length)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for (at, order, _), x in zip(made, merge([t for *_, t in made], length), strict=True):
        blocks[order + at] = x
    seen = []
    for f in range(len(size)):
        s = flat[base[f] : base[f] + size[f]].tobytes() * 3
        seen += [s[k : k + length] for k in range(size[f])]
    place = {s: k for k, s in enumerate(sorted(set(seen)))}
    assert blocks.tolist() == [place[s] for s in seen]  # intervals in the order of their strings
