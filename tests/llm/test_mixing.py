import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tesserine.llm import mixing
from tesserine.llm.common import table
from tests.llm.helpers import docs


def shares(sizes, weights=(1, 2, 3), most=3.0):
    """Targets by source, one source after another."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(order)}
    found, left, free = {}, float(sum(sizes.values())), list(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * unit > most * sizes[s]]
        if not over:
            return found | {s: weight[s] * unit for s in free}
        for s in over:
            found[s] = most * sizes[s]
            left -= found[s]
        free = [s for s in free if s not in found]
    return found


def tilt(sizes, goal):
    """Rates of one source by bisection: min(3, exp(b * size / mean)) with the tokens wanted."""
    total, mean = sum(sizes), sum(sizes) / len(sizes)
    if not total or not goal:
        return [0.0] * len(sizes)
    if goal >= 3 * total * (1 - 1e-12):
        return [3.0] * len(sizes)
    rates = lambda b: [min(3.0, math.exp(min(40.0, b * s / mean))) for s in sizes]
    low, high = -1e6, 1e6
    for _ in range(200):
        b = (low + high) / 2
        low, high = (b, high) if sum(r * s for r, s in zip(rates(b), sizes)) < goal else (low, b)
    return rates((low + high) / 2)


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, None: 100}, {"a": 1000, "b": 100, "c": 10}, {"a": 0}, {}, {"z": 5, "a": 7, "ä": 1000, "B": 3, None: 0, "0": 90},
])
def test_targets(spark, sizes):
    rows = [("1" if s is None else "0" + s, 1, n) for s, n in sizes.items()]
    found = mixing.targets(spark.createDataFrame(rows, "key string, docs long, tokens long")).collect()
    assert {None if r.key == "1" else r.key[1:]: r.target for r in found} == pytest.approx(shares(sizes))


def check(spark, frame):
    out = mixing.mix(frame, keep=("text",)).collect()
    want = sorted(((r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in frame.collect()), key=str)
    assert sorted(((r.doc_id, r.source, r.size) for r in out), key=str) == want
    sizes = defaultdict(int)
    for _, s, n in want:
        sizes[s] += n
    goal = shares(sizes)
    draws = spark.createDataFrame([(r.doc_id, r.row.text) for r in out], "doc_id long, text string")
    draws = [r[0] / 2**40 for r in draws.select(F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text")), F.lit("draw")), F.lit(1 << 40))).collect()]
    for s in sizes:
        own = [(r, d) for r, d in zip(out, draws) if r.source == s]
        rates = tilt([r.size for r, _ in own], goal[s])
        carry, copies = 0.0, {}
        cells = defaultdict(list)
        for k, ((r, d), rate) in enumerate(zip(own, rates)):
            assert r.source_size == sizes[s] and r.target == pytest.approx(goal[s])
            assert r.size == 0 or r.rate == pytest.approx(rate, abs=1e-6)
            rate = r.rate
            copies[k] = int(rate)
            if r.size:
                part = rate - int(rate)
                p = d / part if part > 0 else math.inf
                bucket = 255 if part <= 0 else int(p * 128) if p < 1 else 128 + int((1 - 1 / p) * 127)
                cells[r.size.bit_length()].append((bucket, r.size, part, k))
        for level in sorted(cells, reverse=True):
            need = carry + sum(round(n * p * 1000) for _, n, p, _ in cells[level]) / 1000
            got, cut = 0, 0
            for bucket in sorted({c[0] for c in cells[level]}):
                words = sum(n for b, n, _, _ in cells[level] if b == bucket)
                if bucket == 255 or got + words / 2 > need:
                    break
                got, cut = got + words, bucket + 1
            for b, _, _, k in cells[level]:
                copies[k] += b < cut
            carry = need - got
        assert [r.copies for r, _ in own] == [copies[k] for k in range(len(own))]
        assert all(r.taken == r.copies * r.size <= 3 * r.size for r, _ in own)
        taken = sum(r.taken for r, _ in own)
        assert abs(taken - goal[s]) <= 0.02 * goal[s] + max((r.size for r, _ in own), default=0)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(frame.repartition(3), keep=("text",)).collect()))
    return out


def test_edges(spark):
    check(spark, docs(spark))
    assert mixing.mix(docs(spark).limit(0)).collect() == []


def test_whole_table(spark, sf):
    out = check(spark, table(spark, sf, "documents"))
    by = defaultdict(set)
    for r in out:
        by[r.source].add(r.rate)
    assert any(len(x) > 5 for x in by.values())  # rates differ between the documents of a source


@pytest.mark.parametrize("share", [0.02, 0.31, 1.0, 1.7, 2.9, 3.0])
def test_optimality(spark, share):
    """The rates meet the tokens and the dual's optimality: ln r is linear in size below the cap."""
    sizes = [1, 1, 5, 20, 100, 100, 3000]
    hist = spark.createDataFrame([("k", s, sizes.count(s)) for s in set(sizes)], "key string, size long, n long")
    total = sum(sizes)
    goal = spark.createDataFrame([("k", len(sizes), total, share * total), ("none", 2, 0, 0.0)], "key string, docs long, tokens long, target double")
    rows = {r.key: r for r in mixing.solve(hist, goal).collect()}
    assert rows["none"].b is None
    r = rows["k"]
    rates = [3.0 if r.full else min(3.0, math.exp(r.b * s / r["mean"])) for s in sizes]
    assert sum(x * s for x, s in zip(rates, sizes)) == pytest.approx(share * total)
    assert rates == pytest.approx(tilt(sizes, share * total), abs=1e-6)
