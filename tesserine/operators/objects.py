"""State objects as folds over operation logs: sorted sets, numbers, deques, flows, bitmaps,
names and transactions.

A log has one row per operation: ``oid`` (the object), ``seq`` (its unique order) and what the
operation carries. Operations whose effects combine (latest value, sums, layers) are plain
aggregations, which combine before they shuffle. What depends on the order runs over ranges of the order
(operators/ranges.py), so that no task holds an object. Only compare-and-set and reading a flow
as one string gather an object's log in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.operators.ranges import running_fold, running_sums
from tesserine.sources.scratch import drop_scratch, scratch

KEY = ["oid", "key"]


# -- sorted sets: oid, key, value ------------------------------------------------------------------


def latest(log: DataFrame, by: list[str], order: Column, *values: str) -> DataFrame:
    """The row with the greatest ``order`` of each ``by``; one partial aggregation, no sort."""
    best = F.max_by(F.struct(*values), order).alias("v")
    return log.groupBy(*by).agg(best).select(*by, "v.*")


def layer_merge(layers: DataFrame) -> DataFrame:
    """oid, key, value, layer, seq, is_delete -> the visible items: the highest layer wins, then the
    latest; only then deleted keys go, so that nothing older comes back."""
    top = latest(layers, KEY, F.struct("layer", "seq"), "value", "is_delete")
    return top.filter(~F.col("is_delete")).drop("is_delete")


def insert(state: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (with seq) and their status: OK for the first of a key that the set lacks, else KEY_EXISTS."""
    held = state.select(*KEY, F.lit(True).alias("held"))
    first = rows.groupBy(*KEY).agg(F.min("seq").alias("first"))
    status = F.when(F.col("held") | (F.col("seq") > F.col("first")), "KEY_EXISTS").otherwise("OK")
    return rows.join(first, KEY).join(held, KEY, "left").withColumn("status", status).drop("held", "first")


def upsert(state: DataFrame, rows: DataFrame) -> DataFrame:
    """The set after ``rows`` (with seq) replaced or added their keys; of a key the latest counts."""
    new = latest(rows, KEY, F.col("seq"), "value")
    return state.join(new, KEY, "left_anti").select(*KEY, "value").unionByName(new)


def update(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Old and new value of each of ``rows``; status KEY_NOT_FOUND where the set lacks the key."""
    old = state.select(*KEY, F.col("value").alias("old_value"))
    found = F.when(F.col("old_value").isNull(), "KEY_NOT_FOUND").otherwise("OK")
    return rows.join(old, KEY, "left").withColumn("status", found)


def pop(state: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what is popped, what stays)."""
    return state.join(keys, KEY, "left_semi"), state.join(keys, KEY, "left_anti")


def scan(state: DataFrame, count: int, key: str | None = None, include: bool = True) -> DataFrame:
    """The first ``count`` items in key order from ``key`` on; keys order by their bytes."""
    own = state if key is None else state.filter(F.col("key") >= key if include else F.col("key") > key)
    return own.orderBy("key").limit(count)


def pages(state: DataFrame, size: int = 100) -> DataFrame:
    """Each item of a set with the page on which a scanner meets it."""
    placed = running_sums(state, ["oid"], ["key"], place=F.lit(1))
    return placed.withColumn("page", F.floor(F.col("place") / size).cast("int")).drop("place")


def blocks(state: DataFrame, block_bytes: int = 8192) -> DataFrame:
    """Each item with the block it falls in when a set is rewritten in key order."""
    size = F.octet_length("key") + F.octet_length("value")
    placed = running_sums(state, ["oid"], ["key"], before=size)
    return placed.withColumn("block", F.floor((F.col("before") + size - 1) / block_bytes).cast("int")).drop("before")


def node_stats(state: DataFrame) -> DataFrame:
    k, v = F.octet_length("key"), F.octet_length("value")
    return state.groupBy("oid").agg(
        F.sum(k + v).cast("long").alias("buffered"), F.min(k).alias("min_key"), F.max(k).alias("max_key"), F.min(v).alias("min_value"), F.max(v).alias("max_value")
    )


#: (old operation, new operation) -> what a transaction keeps, or an error; fixed values.
COMPOSE = {
    ("insert", "insert"): "insert",
    ("insert", "update"): "insert",
    ("insert", "remove"): "remove",
    ("update", "insert"): "KEY_EXISTS",
    ("update", "update"): "update",
    ("update", "remove"): "remove",
    ("remove", "insert"): "update",
    ("remove", "update"): "update",
    ("remove", "remove"): "KEY_NOT_FOUND",
}


def compose(old: Column, new: Column) -> Column:
    """What two operations of one transaction on a key come to."""
    out = F.lit(None).cast("string")
    for (a, b), c in COMPOSE.items():
        out = F.when((old == a) & (new == b), c).otherwise(out)
    return out


def floor_lookup(probes: DataFrame, keys: DataFrame, up: bool = False, strict: bool = False) -> DataFrame:
    """For each probe (oid, id, key), the greatest key of the set that is not above it (``up``: the
    least not below); with ``strict``, that is below it (above it). One sorted pass over both sides by
    ranges; nothing is compared pairwise."""
    both = probes.select("oid", "id", "key", F.lit(True).alias("asks")).unionByName(keys.select("oid", F.lit(None).cast("long").alias("id"), "key", F.lit(False).alias("asks")))
    turn = F.desc("asks") if strict else F.asc("asks")  # of equal keys, probes come first if they must not see them
    found = running_fold(both, ["oid"], [F.desc("key") if up else F.asc("key"), turn], F.when(~F.col("asks"), F.col("key")), F.min if up else F.max, "found")
    return found.filter("asks").drop("asks")


# -- numbers: oid, seq, op, v --------------------------------------------------------------------------


def running_sum(log: DataFrame) -> DataFrame:
    """The value after each addition."""
    return running_sums(log, ["oid"], ["seq"], before=F.col("v")).withColumn("value", F.col("before") + F.col("v")).drop("before")


def _wrapped(x: Column) -> Column:
    """A decimal as the signed 64-bit integer that it is congruent to."""
    half, whole = (F.lit(str(1 << k)).cast("decimal(20,0)") for k in (63, 64))
    return (F.pmod(x + half, whole) - half).cast("long")


def _affine(log: DataFrame, by: list[str]) -> DataFrame:
    """Fold rows (a, b) of each ``by`` in order of seq: x -> a * x + b, one after another."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "a", "b")))
    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    wide = lambda x: x.cast("decimal(19,0)")
    then = lambda s, x: F.struct(_wrapped(wide(x["a"]) * wide(s["a"])).alias("a"), _wrapped(wide(x["a"]) * wide(s["b"]) + wide(x["b"])).alias("b"))
    return log.groupBy(*by).agg(F.aggregate(rows, start, then).alias("f"), F.min("seq").alias("seq")).select(*by, "seq", "f.a", "f.b")


def number_maps(log: DataFrame, chunk: int = 1024) -> DataFrame:
    """oid, a and b: what logs of set, add and mul make of a number x, which is a * x + b. Each operation
    is such a map and maps compose, so a log folds in chunks of seq, then in chunks of those, and so on: no
    task holds more than ``chunk`` operations of an object. Numbers are 64 bits wide and wrap, as the maps'
    parts do, so a value that fits is exact whatever its parts come to."""
    a = F.when(F.col("op") == "set", 0).when(F.col("op") == "mul", F.col("v")).otherwise(1).cast("long")
    b = F.when(F.col("op") == "mul", 0).otherwise(F.col("v")).cast("long")
    rows = log.select("oid", "seq", a.alias("a"), b.alias("b"))
    ends = log.agg(F.min("seq").alias("low"), F.max("seq").alias("high")).first()
    width, span = chunk, (ends.high - ends.low) if ends.low is not None else 0
    while width <= span:
        rows = _affine(rows.withColumn("chunk", F.floor((F.col("seq") - ends.low) / width)), ["oid", "chunk"]).drop("chunk")
        width *= chunk
    return _affine(rows, ["oid"]).select("oid", "a", "b")


def fold_numbers(log: DataFrame, chunk: int = 1024) -> DataFrame:
    """oid and final value, from 0."""
    return number_maps(log, chunk).select("oid", F.col("b").alias("value"))


def read_numbers(log: DataFrame, txns: DataFrame, me: int) -> DataFrame:
    """oid and the value that transaction ``me`` reads: the committed operations, then its own."""
    mine = F.col("txn_id") == me
    others = log.join(txns, "txn_id", "left").filter(((F.col("txn_id") == 0) | (F.col("state") == "COMMITTED")) & ~mine)
    base, own = fold_numbers(others), number_maps(log.filter(mine))
    wide = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(19,0)")
    value = F.when(F.col("a").isNull(), F.col("value")).otherwise(_wrapped(wide(F.col("a")) * wide(F.col("value")) + wide(F.col("b"))))
    return base.join(own, "oid", "full").select("oid", value.alias("value"))


def fold_cas(log: DataFrame) -> DataFrame:
    """oid, final value and how many of its compare-and-set operations (old, new) met their value."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "old", "new")))
    start = F.struct(F.lit(0).cast("long").alias("value"), F.lit(0).cast("long").alias("done"))
    step = lambda s, x: F.when(s["value"] == x["old"], F.struct(x["new"].alias("value"), (s["done"] + 1).alias("done"))).otherwise(s)
    return log.groupBy("oid").agg(F.aggregate(rows, start, step).alias("s")).select("oid", "s.*")


# -- deques: oid, seq, op (push_front, push_back, pop_front, pop_back), v ------------------------------------


def fold_deques(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(oid, place, v of what is left, front first; oid, seq, v of every pop, null where the deque was empty).

    The size after a prefix of the log is its sum of +1 and -1 less the least such sum so far (or 0), so
    running sums and minima tell which pops find something. With these, both ends move by running sums
    as well, every push has a place on a line, and a pop takes the last push at its place before it."""
    pops, front = F.col("op").isin("pop_front", "pop_back"), F.col("op").isin("push_front", "pop_front")
    step = F.when(pops, -1).otherwise(1)
    rows = running_sums(log.select("oid", "seq", "op", "v"), ["oid"], ["seq"], level=step)
    rows = running_fold(rows, ["oid"], ["seq"], F.col("level"), F.min, "low")  # of the levels before each row
    rows = rows.withColumn("finds", ~pops | (F.col("level") > F.least("low", F.lit(0))))
    moves = lambda side: F.when(F.col("finds") & side, step).otherwise(0)
    rows = running_sums(rows, ["oid"], ["seq"], ahead=moves(front), behind=moves(~front))
    place = F.when(F.col("op") == "push_front", -F.col("ahead") - 1).when(F.col("op") == "pop_front", -F.col("ahead")).when(F.col("op") == "push_back", F.col("behind")).otherwise(F.col("behind") - 1)
    rows = scratch(rows.filter("finds OR op LIKE 'pop%'").withColumn("place", F.when(F.col("finds"), place)), "deques")
    live = running_fold(rows.filter("finds"), ["oid", "place"], ["seq"], F.when(~pops, F.struct("seq", "v")), F.max, "got")
    taken = live.filter(pops).select("oid", "seq", F.col("got.v").alias("v"))
    none = rows.filter("NOT finds").select("oid", "seq", F.lit(None).cast("long").alias("v"))
    last = rows.filter("finds").groupBy("oid", "place").agg(F.max_by(F.struct("op", "v"), "seq").alias("x"))
    return last.filter("x.op LIKE 'push%'").select("oid", "place", "x.v"), taken.unionByName(none)


# -- flows: oid, seq, data ------------------------------------------------------------------------------------


def flow_offsets(chunks: DataFrame) -> DataFrame:
    """Each appended chunk with the offset it begins at."""
    return running_sums(chunks, ["oid"], ["seq"], offset=F.length("data").cast("long"))


def flow_contents(chunks: DataFrame) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("seq", "data")))
    return chunks.groupBy("oid").agg(F.array_join(F.transform(parts, lambda x: x["data"]), "").alias("data"))


def flow_read_range(chunks: DataFrame, offset: int, size: int) -> DataFrame:
    """``size`` characters from ``offset`` of each flow; only chunks that overlap are gathered."""
    at = flow_offsets(chunks)
    near = at.filter((F.col("offset") < offset + size) & (F.col("offset") + F.length("data") > offset))
    lo = F.greatest(F.lit(offset) - F.col("offset"), F.lit(0))
    hi = F.least(F.lit(offset + size) - F.col("offset"), F.length("data"))
    return flow_contents(near.withColumn("data", F.substr("data", (lo + 1).cast("int"), (hi - lo).cast("int"))))


def flow_edit(chunks: DataFrame, at: int, size: int, more: str = "") -> DataFrame:
    """The chunks of each flow once ``size`` characters from ``at`` on have given way to ``more``, which a flow
    that does not reach ``at`` has at its end. Chunks are cut where they lie, so no flow is gathered. The
    new seq orders what comes before, ``more`` and what comes after."""
    inside = lambda x: F.least(F.greatest(x, F.lit(0)), F.length("data")).cast("int")
    head = F.left("data", inside(F.lit(at) - F.col("offset")))
    tail = F.substr("data", inside(F.lit(at + size) - F.col("offset")) + 1)
    cut = F.array(*[F.struct(F.struct(F.lit(k).alias("part"), "seq").alias("seq"), d.alias("data")) for k, d in ((0, head), (2, tail))])
    rows = flow_offsets(chunks).select("oid", F.inline(cut)).filter("data <> ''")
    place = F.struct(F.lit(1).alias("part"), F.lit(None).cast(chunks.schema["seq"].dataType).alias("seq"))
    return rows.unionByName(chunks.select("oid").distinct().select("oid", place.alias("seq"), F.lit(more).alias("data")))


def flow_inject(chunks: DataFrame, at: int, more: str) -> DataFrame:
    return flow_edit(chunks, at, 0, more)


def flow_write(chunks: DataFrame, at: int, more: str) -> DataFrame:
    return flow_edit(chunks, at, len(more), more)


def flow_remove(chunks: DataFrame, at: int, size: int) -> DataFrame:
    return flow_edit(chunks, at, size)


def flow_truncate(chunks: DataFrame, size: int) -> DataFrame:
    return flow_edit(chunks, size, 1 << 40)


# -- bitmaps: oid, bit -------------------------------------------------------------------------------------------


def bits_set(bits: DataFrame, start: int, size: int) -> DataFrame:
    """oid and whether all bits of the range are set."""
    inside = F.when((F.col("bit") >= start) & (F.col("bit") < start + size), F.col("bit"))
    return bits.groupBy("oid").agg((F.countDistinct(inside) == size).alias("all_set"))


def first_bit(bits: DataFrame, start: int) -> DataFrame:
    return bits.filter(F.col("bit") >= start).groupBy("oid").agg(F.min("bit").alias("bit"))


def _range(bits: DataFrame, start: int, size: int) -> DataFrame:
    return bits.select("oid").distinct().withColumn("bit", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(start + size - 1).cast("long"))))


def mark(bits: DataFrame, start: int, size: int) -> DataFrame:
    return bits.select("oid", "bit").union(_range(bits, start, size)).distinct()


def invert(bits: DataFrame, start: int, size: int) -> DataFrame:
    """The bitmaps with the range's bits turned over: a bit that comes up once of both stays."""
    both = bits.select("oid", "bit").distinct().union(_range(bits, start, size))
    return both.groupBy("oid", "bit").count().filter("count = 1").drop("count")


# -- names: name, oid; and transactions: seq, txn_id, oid, key, value with txn_id, state ------------------------------


def create_names(names: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` names (with seq) and their status: OK for the first request of a name that is not there, else
    OBJECT_EXISTS; nothing is replaced."""
    held = names.select("name", F.lit(True).alias("held"))
    first = new.groupBy("name").agg(F.min("seq").alias("first"))
    status = F.when(F.col("held") | (F.col("seq") > F.col("first")), "OBJECT_EXISTS").otherwise("OK")
    return new.join(first, "name").join(held, "name", "left").select("name", "seq", status.alias("status"))


def open_names(names: DataFrame, asked: DataFrame) -> DataFrame:
    """oid of each asked name by the hash of the name; null and OBJECT_NOT_FOUND where there is none."""
    own = names.select(F.sha2("name", 256).alias("name_key"), "oid")
    found = asked.withColumn("name_key", F.sha2("name", 256)).join(own, "name_key", "left")
    return found.withColumn("status", F.when(F.col("oid").isNull(), "OBJECT_NOT_FOUND").otherwise("OK"))


def visible(log: DataFrame, txns: DataFrame, me: int = 0) -> DataFrame:
    """The latest value of each key that transaction ``me`` sees: committed ones and its own."""
    seen = log.join(txns, "txn_id", "left").filter((F.col("txn_id") == 0) | (F.col("state") == "COMMITTED") | (F.col("txn_id") == me))
    return latest(seen, KEY, F.struct((F.col("txn_id") == me) & F.lit(me != 0), "seq"), "value")


def rolled_back(log: DataFrame, txns: DataFrame) -> DataFrame:
    """Each key that a rolled back transaction wrote: how many of its writes are undone, and the value that
    stays (null if there is none)."""
    undone = log.join(txns.filter("state = 'ROLLEDBACK'"), "txn_id").groupBy(*KEY).agg(F.count("*").alias("undone"))
    return undone.join(visible(log, txns), KEY, "left").select(*KEY, "undone", "value")


def conflicts(log: DataFrame) -> DataFrame:
    """The writes that another transaction's lock rejects. ``log``: seq, txn_id, op, oid and key, where op is
    write, commit or rollback. A write takes the lock of its key unless another transaction holds it, which
    lasts from its write to its commit or rollback; a rejected write takes nothing.

    Each write knows when its transaction ends and so which write could hold the lock next. The writes that do
    hold it are the chain of these from a key's first write on, found by doubling: chains of n writes take
    log2(n) rounds of joins, and no key is gathered."""
    ends = log.filter("op <> 'write'").selectExpr("txn_id AS oid", "seq AS key")
    writes = log.filter("op = 'write'")
    until = floor_lookup(writes.selectExpr("txn_id AS oid", "seq AS id", "seq AS key"), ends, up=True, strict=True).selectExpr("id AS seq", "found AS until")
    own = scratch(writes.select(F.struct(*KEY).alias("k"), *KEY, "seq", "txn_id").join(until, "seq"), "locks")
    asks = own.filter("until IS NOT NULL").selectExpr("k AS oid", "seq AS id", "until AS key")
    jump = scratch(floor_lookup(asks, own.selectExpr("k AS oid", "seq AS key"), up=True).filter("found IS NOT NULL").selectExpr("id AS at", "found AS to"), "jumps")
    holds = scratch(own.groupBy(*KEY).agg(F.min("seq").alias("at")).select("at"), "holds")
    while jump.count():
        more = holds.join(jump, "at").selectExpr("to AS at")
        last, holds = (holds, jump), scratch(holds.union(more).distinct(), "holds")
        jump = scratch(jump.join(jump.selectExpr("at AS to", "to AS next"), "to").selectExpr("at", "next AS to"), "jumps")
        drop_scratch(*last)
    holder = own.join(holds.withColumnRenamed("at", "seq"), "seq").select("seq", F.struct("seq", "txn_id", "until").alias("lock"))
    at = running_fold(own.join(holder, "seq", "left"), KEY, ["seq"], F.col("lock"), F.max, "held")
    rejected = (F.col("held.txn_id") != F.col("txn_id")) & (F.col("held.until").isNull() | (F.col("held.until") > F.col("seq")))
    return at.filter(rejected).select("seq", "txn_id", F.col("held.txn_id").alias("owner"))
