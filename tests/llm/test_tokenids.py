import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserine.llm import tokenids
from tesserine.llm.common import scratch, table
from tests.llm.helpers import docs
from tests.llm.test_packing import plain


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=400), st.integers(0, 399), st.integers(1, 50))
def test_round_trip(ids, start, length):
    ids = np.array(ids, np.uint32)
    payload = tokenids.compress(ids, least=2)
    assert (tokenids.decompress(payload) == ids).all()
    if start + length <= len(ids):
        assert (tokenids.read_slice(payload, start, length) == ids[start : start + length]).all()


def test_it_compresses():
    ids = np.tile(np.arange(200, dtype=np.uint32), 100)
    assert len(tokenids.compress(ids)) < len(ids)


def want(frame):
    rows, at = [], 0
    for r in sorted(frame.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = plain(r.text)
        rows.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return rows


def test_edges(spark):
    frame = docs(spark)
    for shards in (1, 3):
        found = tokenids.read_documents(scratch(tokenids.write_blocks(frame, shards=shards), "t")).orderBy("start")
        assert [tuple(r) for r in found.collect()] == want(frame)
    empty = scratch(tokenids.write_blocks(frame.limit(0)), "t")
    assert tokenids.read_documents(empty).collect() == []


def test_whole_table(spark, sf):
    found = tokenids.op3_token_ids(spark, sf).orderBy("start")
    assert [tuple(r) for r in found.collect()] == want(table(spark, sf, "documents"))


def test_runs_of_one_id():
    ids = np.full(100_000, 7, np.uint32)
    payload = tokenids.compress(ids)
    assert len(payload) < 1000 and (tokenids.decompress(payload) == ids).all()
    mixed = np.concatenate([np.repeat(np.array([3, 9], np.uint32), 501), np.arange(50, dtype=np.uint32), np.full(77, 9, np.uint32)])
    assert (tokenids.decompress(tokenids.compress(mixed, least=2)) == mixed).all()
    assert tokenids.read_slice(payload, 99_990, 10).tolist() == [7] * 10


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=300))
def test_no_frequent_pair_is_left(ids):
    payload = tokenids.compress(np.array(ids, np.uint32), least=2, rounds=1000)
    *_, symbols = tokenids._parts(payload)
    pairs, last = {}, {}
    for k, pair in enumerate(zip(symbols.tolist(), symbols[1:].tolist(), strict=False)):
        if last.get(pair) != k - 1 or pair[0] != pair[1]:  # places that do not overlap
            pairs[pair], last[pair] = pairs.get(pair, 0) + 1, k
    assert len(symbols) < 4 or max(pairs.values(), default=0) < 2


def test_rare_pairs_are_not_looked_at_again(monkeypatch):
    rng = np.random.default_rng(2)
    ids = rng.zipf(1.3, 100_000).clip(max=40_000).astype(np.uint32)
    asked, frequent = [], tokenids._frequent
    monkeypatch.setattr(tokenids, "_frequent", lambda keys, least: asked.append(len(keys)) or frequent(keys, least))
    assert (tokenids.decompress(tokenids.compress(ids)) == ids).all()
    assert len(asked) > 2 and asked[0] < len(ids) - 1 and sum(asked[2:]) < 0.7 * len(ids) * len(asked[2:])


def test_new_chunks_are_cut_together():
    import pyarrow as pa

    from tesserine.llm.common import Encoder, tokenizer_path

    enc, calls = Encoder(tokenizer_path()), []

    class Counted:
        def findall(self, text, units=Encoder.UNITS):
            calls.append(text)
            return units.findall(text)

    enc.UNITS = Counted()
    texts = ["it's we'll x' 's t'", "O'RE É×÷ß naïve'd 12 '", "<|endoftext|> 日本 a<|b '’s", "", " ", "it's 's we'll 't'"]
    for _ in range(2):
        ids, bounds = enc.encode(pa.array(texts, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [plain(t)[:-1].tolist() for t in texts]
    assert len(calls) == 1
    enc.forget()
    assert enc.encode(pa.array(texts, pa.large_string()))[0].tolist() == ids.tolist()
