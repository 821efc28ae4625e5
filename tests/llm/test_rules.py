import re
from collections import Counter
from math import comb

import duckdb
import pytest

from tesserine.llm import rules
from tesserine.llm.common import table
from tests.llm.helpers import TEXTS, docs


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in rules.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(covered))


MORE = [(20, "a b c\na b c\n\nx <|> $$\na b c"), (21, "q w e r t q w e r t y"), (22, "\n\n"), (23, "a a a a a"), (24, "x y z " * 3000 + "end\nend\n end")]


def test_measures(spark):
    frame = docs(spark, TEXTS + MORE)
    found = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.measures(frame).collect()}
    assert found == {(i, *plain(t)) for i, t in TEXTS + MORE}
    assert rules.measures(frame.limit(0)).collect() == []


def test_whole_table_against_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = con.sql(rules.ORACLE_SQL["op1_risk_controlled_rules"]).fetchall()
    assert sorted(map(tuple, rules.op1_quality_rules(spark, sf).collect())) == sorted(want)


def test_tail_is_the_binomial_tail():
    for k, n, p in ((0, 10, 0.1), (3, 50, 0.02), (50, 50, 0.3)):
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert rules.tail(k, n, p) == pytest.approx(want, rel=1e-9)


def measured(spark, rows):
    cols = "doc_id long, stratum string, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bangs long, base_failed boolean"
    return spark.createDataFrame(rows, cols)


def test_risk_is_controlled(spark):
    """Bad documents are full of symbols; a few good ones too. The certified cutoff rejects the
    bad and at most the allowed share of good ones, and none without enough labels."""
    rows, labels = [], []
    for i in range(9000):
        bad = i % 9 == 0
        symbols = 200 if bad or i % 2000 == 1 else 2
        rows.append((i, "en" if i < 8900 else "xx", i, 100, 500, symbols, 0, 0, 0, False))
        labels.append((i, 0 if bad else 1))
    frame = measured(spark, rows)
    quality = spark.createDataFrame([*labels, (1, None), (2, 0)], "doc_id long, quality int")
    found = rules.cutoffs(frame, quality)
    assert set(found["symbols"]) == {"en"} and not any(v for k, v in found.items() if k != "symbols")
    kept = {r.doc_id for r in frame.filter(~rules.verdict(found)).collect()}
    good = [i for i, q in labels if q and i < 8900]
    assert sum(i not in kept for i in good) <= rules.ALPHA * len(good)
    assert not any(i in kept for i, q in labels if not q and i < 8900 and i != 1)
    assert all(i in kept for i in range(8900, 9000))


def test_copies_are_one_trial(spark):
    """Neither repeated rows nor copies under other ids change a cutoff: they are no new evidence."""
    rows, labels = [], []
    for i in range(3000):
        bad = i % 3 == 0
        rows.append((i, "en", i, 100, 500, 200 if bad else 2, 0, 0, 0, False))
        labels.append((i, 0 if bad else 1))
    few = [r for r in rows if r[0] < 90]
    quality = spark.createDataFrame(labels + [(i + 10_000 * c, q) for i, q in labels[:90] for c in range(1, 60)], "doc_id long, quality int")
    copies = [(r[0] + 10_000 * c, *r[1:]) for r in few for c in range(60)]
    once, again, other = (rules.cutoffs(measured(spark, x), quality) for x in (few, few * 60, copies))
    assert once == again == other and not any(once.values())
    whole = rules.cutoffs(measured(spark, rows), quality)
    assert whole["symbols"] and rules.cutoffs(measured(spark, rows + rows + copies), quality) == whole


def test_no_labels(spark):
    frame = rules.measures(docs(spark))
    found = rules.cutoffs(frame, spark.createDataFrame([], "doc_id long, quality int"))
    assert frame.filter(rules.verdict(found)).count() == 0
