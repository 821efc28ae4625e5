"""State objects, tables and functions on small logs with hand-computed results."""

import hashlib
import random
import zlib
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from tesserine.functions import hashes, scalars
from tesserine.operators import metrics, objects, ranges, tables
from tesserine.streaming import events as streams


def test_deque_order(spark):
    pushes = [("push_front", 1), ("push_front", 2), ("push_back", 3), ("push_back", 4), ("push_front", 5), ("push_back", 6)]
    pops = ["pop_front", "pop_front", "pop_back", "pop_back", "pop_front", "pop_back", "pop_front"]
    log = [(1, k, op, v) for k, (op, v) in enumerate(pushes)]
    frame = spark.createDataFrame(log, "oid long, seq long, op string, v long")
    left, popped = objects.fold_deques(frame)
    assert [r.v for r in left.orderBy("place").collect()] == [5, 2, 1, 3, 4, 6] and popped.count() == 0
    more = spark.createDataFrame([(1, 10 + k, op, None) for k, op in enumerate(pops)], frame.schema)
    left, popped = objects.fold_deques(frame.union(more))
    assert left.count() == 0 and [r.v for r in popped.orderBy("seq").collect()] == [5, 2, 6, 4, 1, 3, None]


def test_deques_against_model(spark):
    rng = random.Random(4)
    ops = ["push_front", "push_back", "pop_front", "pop_back"]
    log = [(rng.randrange(3), k, rng.choice(ops if k % 300 < 150 else ops[2:] + ops), k) for k in range(1500)]
    left, popped, model = defaultdict(deque), {}, None
    for oid, k, op, v in log:
        model = left[oid]
        if op == "push_front":
            model.appendleft(v)
        elif op == "push_back":
            model.append(v)
        else:
            popped[k] = (model.popleft() if op == "pop_front" else model.pop()) if model else None
    found, gone = objects.fold_deques(spark.createDataFrame(log, "oid long, seq long, op string, v long").repartition(5))
    assert {r.seq: r.v for r in gone.collect()} == popped
    rows = found.orderBy("oid", "place").collect()
    assert {o: [r.v for r in rows if r.oid == o] for o in left} == {o: list(x) for o, x in left.items()}


def test_flow_edits_cut_chunks(spark):
    rng = random.Random(6)
    rows = [(oid, k, rng.choice(["", None, "ab", "cdefg", "\u00e9\u4e2d" * 4])) for oid in range(6) for k in range(oid * 9)]
    rows += [(7, 0, None), (8, 0, ""), (9, 0, "x" * 12), (9, 0 + 1, "y")]
    chunks = spark.createDataFrame(rows, "oid long, seq long, data string")
    whole = defaultdict(str)
    for oid, _, data in rows:
        whole[oid] += data or ""
    for at, size, more in ((10, 0, "<<x>>"), (10, 5, "<<x>>"), (3, 20, ""), (0, 1, "z"), (12, 1 << 40, "")):
        edited = objects.flow_edit(chunks, at, size, more)
        like = {oid: x[:at] + more + x[at + size :] for oid, x in whole.items()}
        assert {r.oid: r.data for r in objects.flow_contents(edited).collect()} == like
    twice = objects.flow_inject(objects.flow_truncate(chunks, 20), 4, "--")
    assert {r.oid: r.data for r in objects.flow_contents(twice).collect()} == {oid: x[:20][:4] + "--" + x[:20][4:] for oid, x in whole.items()}


def test_numbers(spark):
    log = [("set", 5), ("mul", 3), ("mul", -10), ("add", 7), ("set", 4), ("add", -9), ("mul", 2)]
    rows = [(1, k, op, v) for k, (op, v) in enumerate(log)]
    frame = spark.createDataFrame(rows, "oid long, seq long, op string, v long")
    for chunk in (2, 3, 100):
        assert objects.fold_numbers(frame, chunk).first()["value"] == -10
    assert objects.fold_numbers(frame.filter("seq < 4"), 2).first()["value"] == -143
    cas = spark.createDataFrame([(1, 0, 0, 50), (1, 1, 50, -100), (1, 2, 10, 3)], "oid long, seq long, old long, new long")
    assert tuple(objects.fold_cas(cas).first()) == (1, -100, 2)


def test_numbers_that_products_would_overflow(spark):
    def value(log, **how):
        rows = [(1, k, op, v) for k, (op, v) in enumerate(log)]
        return objects.fold_numbers(spark.createDataFrame(rows, "oid long, seq long, op string, v long"), **how).first()["value"]

    assert value([("mul", 10)] * 25) == 0
    assert value([("add", 3)] + [("mul", 10)] * 25 + [("set", 7), ("mul", 6)], chunk=4) == 42
    assert value([("set", (1 << 63) - 1), ("add", 1)]) == -(1 << 63)  # numbers of 64 bits wrap
    want = 1
    for k in range(40):
        want = want * (k + 3) - k
    want = (want + (1 << 63)) % (1 << 64) - (1 << 63)
    assert value([("set", 1)] + [x for k in range(40) for x in (("mul", k + 3), ("add", -k))], chunk=3) == want


def test_reads_in_a_transaction(spark):
    log = [(1, 0, "set", 10, 1), (1, 1, "add", 5, 2), (1, 2, "mul", 3, 3), (1, 3, "set", 99, 4), (2, 4, "add", 7, 3)]
    frame = spark.createDataFrame(log, "oid long, seq long, op string, v long, txn_id long")
    txns = spark.createDataFrame([(1, "COMMITTED"), (2, "COMMITTED"), (3, "WAIT_COMMIT"), (4, "ROLLEDBACK")], "txn_id long, state string")
    read = lambda me: {r.oid: r.value for r in objects.read_numbers(frame, txns, me).collect()}
    assert read(0) == {1: 15} and read(3) == {1: 45, 2: 7} and read(4) == {1: 99}


def test_locks(spark):
    """A lock ends with its holder's commit or rollback; a rejected write takes none."""
    rows = [
        (1, 1, "write", "a"), (2, 2, "write", "a"), (3, 1, "write", "a"), (4, 2, "write", "b"), (5, 1, "commit", None), (6, 2, "write", "a"),
        (7, 3, "write", "a"), (8, 2, "rollback", None), (9, 3, "write", "b"), (10, 1, "write", "b"), (11, 3, "write", "a"), (12, 4, "write", "a"),
    ]
    log = spark.createDataFrame([(s, t, op, 1, k) for s, t, op, k in rows], "seq long, txn_id long, op string, oid long, key string")
    found = {r.seq: (r.txn_id, r.owner) for r in objects.conflicts(log).collect()}
    assert found == {2: (2, 1), 7: (3, 2), 10: (1, 3), 12: (4, 3)}


def test_repeated_keys_in_one_batch(spark):
    state = spark.createDataFrame([(1, "a", "x")], "oid long, key string, value string")
    new = spark.createDataFrame([(1, "a", "1", 0), (1, "b", "2", 2), (1, "b", "3", 1), (2, "b", "4", 5)], "oid long, key string, value string, seq long")
    assert {(r.oid, r.key, r.seq): r.status for r in objects.insert(state, new).collect()} == {(1, "a", 0): "KEY_EXISTS", (1, "b", 2): "KEY_EXISTS", (1, "b", 1): "OK", (2, "b", 5): "OK"}
    df = spark.createDataFrame([(1, "old")], "k int, v string")
    more = spark.createDataFrame([(1, "p", 1), (2, "q", 1), (2, "r", 2)], "k int, v string, at int")
    assert sorted(map(tuple, tables.upsert(df, more, ["k"], order="at").collect())) == [(1, "p"), (2, "r")]
    assert sorted(map(tuple, tables.upsert(df, more, ["k"], replace=False, order="at").collect())) == [(1, "old"), (2, "q")]
    none = spark.createDataFrame([(1, None)], "k int, v string")
    assert [tuple(r) for r in tables.merge(df, none, ["k"]).collect()] == [(1, None)]


def test_one_object_in_many_parts(spark):
    """No part of a set of one object holds it all, and results do not depend on the parts."""
    rows = spark.range(5000).selectExpr("1L AS oid", "lpad(id, 8, '0') AS key", "'v' AS value", "id AS seq", "1L AS v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which small tables would be subject to
    try:
        _in_parts(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _in_parts(rows):
    parts = ranges.parted(rows, ["oid"], ["key"])
    assert parts.groupBy("_part").count().agg(F.max("count")).first()[0] < 4000
    assert objects.pages(rows, 7).filter("page <> floor(seq / 7)").count() == 0
    assert objects.running_sum(rows).filter("value <> seq + 1").count() == 0
    near = objects.floor_lookup(rows.selectExpr("oid", "seq AS id", "seq AS key"), rows.filter("seq % 100 = 0").selectExpr("oid", "seq AS key"))
    assert near.filter("found <> key - key % 100").count() == 0


def test_streams_by_batches(spark, tmp_path):
    """Three files are three batches; each user has one row, and a batch that runs again adds none."""
    rows = [(k, k % 5, "purchase" if k % 2 else "view") for k in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[20 * part : 20 * part + 20], "event_id long, user_id long, event_type string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("event_id long, user_id long, event_type string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = streams.finish(streams.numbers(source), "update", ["user_id"]).collect()
    assert sorted(map(tuple, found)) == [(u, 6) for u in range(5)]
    out = str(tmp_path / "out")
    batch = spark.createDataFrame([(1, 10)], "user_id long, value long")
    for number in (0, 1, 1):
        streams.sink(out)(batch.withColumn("value", F.col("value") + number), number)
    assert [tuple(r) for r in streams.result(spark, out, batch.schema, "update", ["user_id"]).collect()] == [(1, 11)]
    assert streams.result(spark, out, batch.schema, "append", []).count() == 2


def test_set_against_model(spark):
    sha = lambda x: hashlib.sha1(str(x).encode()).hexdigest()
    n = 1092
    base = spark.createDataFrame([(1, sha(i), sha(f"{i}-v1"), 0, i, False) for i in range(n)], "oid int, key string, value string, layer int, seq long, is_delete boolean")
    newer = spark.createDataFrame([(1, sha(i), None if i % 2 else sha(f"{i}-v2"), 1, i, i % 2 == 1) for i in range(n)], base.schema)
    state = objects.layer_merge(base.union(newer))
    expect = sorted((sha(i), sha(f"{i}-v2")) for i in range(0, n, 2))
    assert [(r.key, r.value) for r in state.orderBy("key").collect()] == expect
    assert [r.key for r in objects.scan(state, 3, expect[5][0], include=False).collect()] == [k for k, _ in expect[6:9]]
    assert objects.scan(state, 3).count() == 3


def test_sessions(spark):
    s = tables.Session(spark)
    s.create("t", "a int")
    s.begin()
    s.put("t", tables.insert_rows(s.tables["t"], [(1,)]))
    s.savepoint("x")
    s.put("t", tables.insert_rows(s.tables["t"], [(2,)]))
    s.rollback("x")
    assert [r.a for r in s.sql("SELECT a FROM {t}").collect()] == [1]
    s.rollback()
    assert s.tables["t"].count() == 0
    with pytest.raises(ValueError):
        s.create("t", "a int")
    with pytest.raises(KeyError):
        s.drop("none")
    s.drop("t")


def test_hashes(spark):
    frame = spark.createDataFrame([("abc",), ("",), (None,), ("123456789",), ("é",)], "s string")
    got = lambda f: [r[0] for r in frame.select(f(F.col("s"))).collect()]
    assert got(hashes.murmur3(42))[0] == 1313807976
    assert got(hashes.crc32c)[3] == 0xE3069283
    assert got(hashes.adler32)[3] == 0x091E01DE
    many = ["", "a", "ab", "abc", "abcd", "é" * 40, "x" * 1000]
    longer = spark.createDataFrame([(x,) for x in many], "s string").select(hashes.adler32(F.col("s"))).collect()
    assert [r[0] for r in longer] == [zlib.adler32(x.encode()) for x in many]
    assert got(lambda c: hashes.lcg_rand(F.length(c).cast("long")))[2] is None
    x31 = got(hashes.rolling("x31"))
    assert x31[:3] == [96354, 0, None] and x31[4] == 31 * 0xC3 + 0xA9
    assert got(hashes.rolling("djb", 5381))[0] == 193485963


def test_scalars(spark):
    frame = spark.createDataFrame([(0, "ab", "abc"), (-1, "", "x"), (1 << 40, "xbc", "abc"), (-(1 << 63), "a", "a")], "n long, a string, b string")
    n, a, b = (F.col(c) for c in "nab")
    rows = frame.select(scalars.zigzag(n), scalars.unzigzag(scalars.zigzag(n)), scalars.varint_size(n), scalars.uint_bytes(n), scalars.shared_prefix(a, b), scalars.shared_suffix(a, b)).collect()
    assert [tuple(r) for r in rows] == [(0, 0, 1, 1, 2, 0), (1, -1, 10, 8, 0, 0), (1 << 41, 1 << 40, 6, 6, 0, 2), (-1, -(1 << 63), 10, 8, 1, 1)]
    sizes = spark.createDataFrame([(12,), (1536,), (3 << 30,), (90_000_000,)], "n long").select(scalars.human_size(F.col("n")), scalars.human_time(F.col("n"))).collect()
    assert [r[0] for r in sizes] == ["12bytes", "1.50KiB", "3.00GiB", "85.83MiB"]
    assert [r[1] for r in sizes][0] == "12usec" and sizes[3][1] == "1.50min"


def test_parse_int(spark):
    frame = spark.createDataFrame([("ff",), (" -7Fz",), ("+10",), ("z",), ("",), (None,)], "s string")
    assert [r[0] for r in frame.select(scalars.parse_int(F.col("s"), 16)).collect()] == [255, -127, 16, None, None, None]
    assert [r[0] for r in frame.select(scalars.parse_int(F.col("s"), 2)).collect()] == [None, None, 2, None, None, None]


def test_histogram_beyond_bounds(spark):
    frame = spark.createDataFrame([(float(v),) for v in (1, 5, 6, 100)], "v double")
    assert {(r.bucket, r.n) for r in metrics.histogram(frame, "v", (5, 10)).collect()} == {(0, 2), (1, 1), (2, 1)}
    assert {(r.share, r.bound) for r in metrics.histogram_percentile(frame, "v", (5, 10), (50, 75, 100)).collect()} == {(50, 5.0), (75, 10.0), (100, 100.0)}
