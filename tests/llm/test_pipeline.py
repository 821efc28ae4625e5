"""The pipeline's stages against brute force on small inputs."""

import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P
from tests.llm.helpers import docs
from tests.llm.test_repeats import brute
from tests.llm.test_simhash import brute as brute_groups
from tests.llm.test_simhash import plain_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_names():
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "repeats", "mixing", "packing"]


def test_quality_keeps_whole_rows(spark, sf, documents):
    kept = P.good_quality(spark, documents, sf)
    assert kept.columns == COLUMNS
    rows = {r.doc_id: r for r in documents.collect()}
    found = kept.collect()
    assert len(found) > len(rows) / 2 and all(rows[r.doc_id] == r for r in found)


def test_one_of_each_group(spark, sf, documents):
    found = P.one_of_near_duplicates(spark, documents, sf)
    assert found.columns == COLUMNS
    expect = brute_groups([(r.doc_id, plain_fingerprint(r.text)) for r in documents.collect()])
    assert sorted(r.doc_id for r in found.collect()) == sorted({c for _, _, c in expect})


def test_one_of_repeated_rows(spark, sf):
    found = P.one_of_near_duplicates(spark, docs(spark), sf)
    assert found.columns == docs(spark).columns
    ids = Counter(r.doc_id for r in found.collect())
    assert ids[1] == 1 and ids[7] == 0  # 7 is a copy of 1, twice
    assert ids[2] == 1 and ids[3] == ids[4] == 0  # without words
    assert ids[None] == 1


def test_repeats(spark, sf, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    expect = {i: k.decode("utf-8", "ignore") for (i, _), (k, _) in zip(rows, brute(rows, 50), strict=True)}
    found = P.without_repeats(spark, documents, sf)
    assert found.columns == COLUMNS
    rest = {r.doc_id: (r.lang, r.source) for r in documents.collect()}
    for r in found.collect():
        assert r.text == expect.pop(r.doc_id) and r.n_chars == len(r.text) and rest[r.doc_id] == (r.lang, r.source)
    assert not expect


def test_mixing_repeats_rows(spark, sf, documents):
    found = P.mixed_sources(spark, documents, sf)
    assert found.columns == COLUMNS
    rows = {r.doc_id: r for r in documents.collect()}
    copies = Counter()
    for r in found.collect():
        assert rows[r.doc_id] == r
        copies[r.doc_id] += 1
    from tesserine.llm.mixing import mix

    assert copies == {r.doc_id: r.copies for r in mix(documents).collect() if r.copies}


def test_run(spark, sf):
    pieces = P.run(spark, sf).collect()
    assert pieces
    by_window = defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length and zlib.crc32(p.ids) == p.ids_crc32
        by_window[p.sequence_id].append((p.offset, p.length))
    for own in by_window.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_edge_rows(spark, sf, empty):
    """Nulls, repeated rows, texts without words, further columns with clashing names, and no rows at all."""
    from tesserine.llm.common import scratch

    frame = scratch(docs(spark).limit(0) if empty else docs(spark), "edges")
    for name, stage in P.STAGES:
        found = scratch(stage(spark, frame, sf), name)
        if name != "packing":
            assert found.columns == docs(spark).columns
        if name != "quality":  # which rejects nearly all of these
            frame = found
            assert bool(found.count()) != empty
