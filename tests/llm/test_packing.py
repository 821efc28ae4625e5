import zlib
from collections import defaultdict

import numpy as np

from tesserine.llm import packing
from tesserine.llm.common import table, tokenizer_path
from tests.llm.helpers import docs


def plain(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check(rows, texts):
    """Every id in one piece, sequences gapless and within capacity; returns the padding share."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc, text in texts:
        ids, at = plain(text), 0
        pieces = sorted(by_doc[doc], key=lambda r: (r.start, r.sequence_id))
        copies = sum(1 for d, _ in texts if d == doc)
        assert sum(r.length for r in pieces) == copies * len(ids)
        for r in pieces:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            if copies == 1:
                assert r.start == at
                at += r.length
    used = pad = 0
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and all(r.sequence_tokens == at for r in s)
        used += at
        pad += 0 if at & (at - 1) == 0 else 2048 - at
    return pad / max(1, used + pad)


def test_edges(spark):
    frame = docs(spark)
    rows = packing.pack(frame).collect()
    check(rows, [(r.doc_id, r.text) for r in frame.collect()])
    assert packing.pack(frame.limit(0)).collect() == []


def test_whole_table(spark, sf):
    frame = table(spark, sf, "documents")
    rows = packing.op2_pack(spark, sf).collect()
    assert check(rows, [(r.doc_id, r.text) for r in frame.collect()]) < 0.02


def test_difference_is_balanced():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 2000, 900).tolist()
    found = packing.difference(sizes, 100)
    assert sorted(i for w in found for i in w) == list(range(900))
    sums = [sum(sizes[i] for i in w) for w in found]
    assert max(sums) - min(sums) < 200
    assert packing.difference([], 3) == [[], [], []]
    assert all(sum(sizes[i] for i in w) <= 2048 for w in packing.windows(sizes, 2048))
