"""Queries of the state objects, tables, metrics, functions and streams, with their SQL twins.

The logs come from the driver tables: events are operations of user objects, customers the items
of one sorted set for each nation, conversations the chunks of flows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.functions import hashes, scalars
from tesserine.operators import metrics, objects, tables
from tesserine.sources.tables import table
from tesserine.streaming import events as streams

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _set(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("oid"), F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))


SET = "s AS (SELECT c_nationkey oid, c_name AS key, c_mktsegment AS value FROM customer)"


def _writes(spark, sf) -> DataFrame:
    """Writes to the sets from events; user_id names a customer, event_type is the value."""
    e = table(spark, sf, "events")
    key = F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    return e.select((F.col("user_id") % 25).cast("int").alias("oid"), key.alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))


WRITES = "w AS (SELECT CAST(user_id % 25 AS INTEGER) oid, 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS key, event_type AS value, event_id seq FROM events)"
LATEST = "n AS (SELECT oid, key, arg_max(value, seq) AS value FROM w GROUP BY oid, key)"


# -- sorted sets -----------------------------------------------------------------------------------------


@query("sset_insert", f"WITH {SET}, {WRITES} SELECT w.oid, w.key, w.value, w.seq, CASE WHEN s.key IS NULL AND row_number() OVER (PARTITION BY w.oid, w.key ORDER BY w.seq) = 1 THEN 'OK' ELSE 'KEY_EXISTS' END AS status FROM w LEFT JOIN s ON w.oid = s.oid AND w.key = s.key")
def sset_insert(spark, sf):
    return objects.insert(_set(spark, sf), _writes(spark, sf))


@query("sset_upsert", f"WITH {SET}, {WRITES}, {LATEST} SELECT s.oid, s.key, s.value FROM s LEFT JOIN n ON n.oid = s.oid AND n.key = s.key WHERE n.key IS NULL UNION ALL SELECT oid, key, value FROM n")
def sset_upsert(spark, sf):
    return objects.upsert(_set(spark, sf), _writes(spark, sf))


@query("sset_update", f"WITH {SET}, {WRITES}, {LATEST} SELECT n.oid, n.key, n.value, s.value AS old_value, CASE WHEN s.value IS NULL THEN 'KEY_NOT_FOUND' ELSE 'OK' END AS status FROM n LEFT JOIN s ON n.oid = s.oid AND n.key = s.key")
def sset_update(spark, sf):
    return objects.update(_set(spark, sf), objects.latest(_writes(spark, sf), objects.KEY, F.col("seq"), "value"))


@query("sset_pop", f"WITH {SET}, {WRITES} SELECT s.oid, s.key, s.value, EXISTS (SELECT 1 FROM w WHERE w.oid = s.oid AND w.key = s.key) AS popped FROM s")
def sset_pop(spark, sf):
    gone, rest = objects.pop(_set(spark, sf), _writes(spark, sf).select(*objects.KEY).distinct())
    return gone.withColumn("popped", F.lit(True)).unionByName(rest.withColumn("popped", F.lit(False)))


@query("sset_get", f"WITH {SET} SELECT oid, value FROM s WHERE key = 'Customer#000000042'")
def sset_get(spark, sf):
    return _set(spark, sf).filter("key = 'Customer#000000042'").select("oid", "value")


for _name, _args, _where in (
    ("sset_scan_first", (20,), "true"),
    ("sset_scan_inclusive", (20, "Customer#000000050"), "key >= 'Customer#000000050'"),
    ("sset_scan_exclusive", (20, "Customer#000000050", False), "key > 'Customer#000000050'"),
):
    query(_name, f"WITH {SET} SELECT key, value FROM s WHERE {_where} ORDER BY key LIMIT 20")(lambda spark, sf, a=_args: objects.scan(_set(spark, sf), *a).select("key", "value"))


@query("sset_pages", f"WITH {SET} SELECT oid, key, CAST((row_number() OVER (PARTITION BY oid ORDER BY key) - 1) // 10 AS INTEGER) AS page FROM s")
def sset_pages(spark, sf):
    return objects.pages(_set(spark, sf), 10).select("oid", "key", "page")


@query(
    "sset_layer_merge",
    f"""WITH {SET}, {WRITES}, l AS (
SELECT oid, key, value, 0 AS layer, -1 AS seq, false AS is_delete FROM s
UNION ALL SELECT oid, key, value, 1 + CAST(seq % 2 AS INTEGER), seq, value = 'error' FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY oid, key ORDER BY layer DESC, seq DESC) AS rn FROM l)
SELECT oid, key, value FROM r WHERE rn = 1 AND NOT is_delete""",
)
def sset_layer_merge(spark, sf):
    base = _set(spark, sf).withColumns({"layer": F.lit(0), "seq": F.lit(-1).cast("long"), "is_delete": F.lit(False)})
    new = _writes(spark, sf).withColumns({"layer": (1 + F.col("seq") % 2).cast("int"), "is_delete": F.col("value") == "error"})
    return objects.layer_merge(base.unionByName(new))


@query("sset_blocks", f"WITH {SET} SELECT oid, key, CAST((sum(strlen(key) + strlen(value)) OVER (PARTITION BY oid ORDER BY key ROWS UNBOUNDED PRECEDING) - 1) // 256 AS INTEGER) AS block FROM s")
def sset_blocks(spark, sf):
    return objects.blocks(_set(spark, sf), 256).select("oid", "key", "block")


@query("sset_node_stats", f"WITH {SET} SELECT oid, CAST(sum(strlen(key) + strlen(value)) AS BIGINT) AS buffered, CAST(min(strlen(key)) AS INTEGER) AS min_key, CAST(max(strlen(key)) AS INTEGER) AS max_key, CAST(min(strlen(value)) AS INTEGER) AS min_value, CAST(max(strlen(value)) AS INTEGER) AS max_value FROM s GROUP BY oid")
def sset_node_stats(spark, sf):
    return objects.node_stats(_set(spark, sf))


@query("sset_min_max", f"WITH {SET} SELECT oid, min(key) AS low, arg_min(value, key) AS low_value, max(key) AS high, arg_max(value, key) AS high_value FROM s GROUP BY oid")
def sset_min_max(spark, sf):
    return _set(spark, sf).groupBy("oid").agg(F.min("key").alias("low"), F.min_by("value", "key").alias("low_value"), F.max("key").alias("high"), F.max_by("value", "key").alias("high_value"))


@query("map_contains", f"WITH {SET}, {WRITES} SELECT DISTINCT w.oid, w.key, s.key IS NOT NULL AS held FROM w LEFT JOIN s ON w.oid = s.oid AND w.key = s.key")
def map_contains(spark, sf):
    return _writes(spark, sf).select(*objects.KEY).distinct().join(_set(spark, sf).select(*objects.KEY, F.lit(True).alias("held")), objects.KEY, "left").fillna(False, ["held"])


_KINDS = {"signup": "insert", "view": "insert", "click": "update", "purchase": "update", "error": "remove"}


def _kind(column):
    return F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])[column]


_KIND_SQL = "CASE {} WHEN 'signup' THEN 'insert' WHEN 'view' THEN 'insert' WHEN 'error' THEN 'remove' ELSE 'update' END"
_COMPOSE_SQL = "CASE " + " ".join(f"WHEN a = '{a}' AND b = '{b}' THEN '{c}'" for (a, b), c in objects.COMPOSE.items()) + " END"


@query("sset_txn_compose", f"WITH p AS (SELECT event_id, {_KIND_SQL.format('event_type')} AS b, {_KIND_SQL.format('lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id)')} AS a, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS l FROM events) SELECT event_id, {_COMPOSE_SQL} AS kept FROM p WHERE l IS NOT NULL")
def sset_txn_compose(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id", "event_type", "lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prior")
    return e.filter("prior IS NOT NULL").select("event_id", objects.compose(_kind(F.col("prior")), _kind(F.col("event_type"))).alias("kept"))


for _name, _up, _sql in (("lookup_floor", False, "max(c.c_acctbal)"), ("lookup_ceil", True, "min(c.c_acctbal)")):

    def _lookup(spark, sf, up=_up):
        probes = table(spark, sf, "supplier").selectExpr("s_nationkey AS oid", "s_suppkey AS id", "s_acctbal AS key")
        keys = table(spark, sf, "customer").selectExpr("c_nationkey AS oid", "c_acctbal AS key")
        return objects.floor_lookup(probes, keys, up)

    query(_name, f"SELECT s.s_nationkey AS oid, s.s_suppkey AS id, s.s_acctbal AS key, {_sql} AS found FROM supplier s LEFT JOIN customer c ON c.c_nationkey = s.s_nationkey AND c.c_acctbal {'>=' if _up else '<='} s.s_acctbal GROUP BY ALL")(_lookup)

for _name, _up, _sql in (("lookup_below", False, "max(b.o_orderkey)"), ("lookup_above", True, "min(b.o_orderkey)")):

    def _neighbour(spark, sf, up=_up):
        own = table(spark, sf, "orders")
        return objects.floor_lookup(own.selectExpr("o_custkey AS oid", "o_orderkey AS id", "o_orderkey AS key"), own.selectExpr("o_custkey AS oid", "o_orderkey AS key"), up, strict=True).select("oid", "key", "found")

    query(_name, f"SELECT a.o_custkey AS oid, a.o_orderkey AS key, {_sql} AS found FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderkey {'>' if _up else '<'} a.o_orderkey GROUP BY ALL")(_neighbour)


@query("cache_lru_survivors", "SELECT user_id, max(event_id) AS last_access FROM events GROUP BY user_id ORDER BY last_access DESC LIMIT 50")
def cache_lru_survivors(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("last_access")).orderBy(F.desc("last_access")).limit(50)


# -- numbers -----------------------------------------------------------------------------------------------


def _ops(spark, sf) -> DataFrame:
    """signup sets, view multiplies by -3 to 3, the others add; a view whose factor is 0 multiplies by a million."""
    n = F.floor("value").cast("long") % 7
    factor = F.when(n == 3, 1_000_000).otherwise(n - 3)
    v = n - F.when(F.col("event_type") == "click", 5).otherwise(0)
    op = F.when(F.col("event_type") == "signup", "set").when(F.col("event_type") == "view", "mul").otherwise("add")
    return table(spark, sf, "events").select(F.col("user_id").alias("oid"), F.col("event_id").alias("seq"), op.alias("op"), F.when(op == "mul", factor).otherwise(v).cast("long").alias("v"), (F.col("event_id") % 10).alias("txn_id"))


OPS = """o AS (SELECT user_id oid, event_id seq, CASE event_type WHEN 'signup' THEN 'set' WHEN 'view' THEN 'mul' ELSE 'add' END op,
  CASE WHEN event_type <> 'view' THEN CAST(floor(value) AS BIGINT) % 7 - CASE WHEN event_type = 'click' THEN 5 ELSE 0 END
  WHEN CAST(floor(value) AS BIGINT) % 7 = 3 THEN 1000000 ELSE CAST(floor(value) AS BIGINT) % 7 - 3 END v, event_id % 10 txn_id FROM events)"""
#: An ordered fold as recursion: {x} is the table of operations, {step} the new value of f.a.
FOLD = """WITH RECURSIVE {x}, n AS (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY seq) rn FROM o),
f AS (SELECT DISTINCT oid, CAST(0 AS BIGINT) rn, {start} FROM n UNION ALL SELECT f.oid, n.rn, {step} FROM f JOIN n ON n.oid = f.oid AND n.rn = f.rn + 1)
SELECT oid, {out} FROM f GROUP BY oid"""
#: Steps of a number of 64 bits, which wraps.
_WHOLE = "CASE n.op WHEN 'set' THEN CAST(n.v AS HUGEINT) WHEN 'mul' THEN CAST(f.a AS HUGEINT) * n.v ELSE CAST(f.a AS HUGEINT) + n.v END"
_STEP64 = f"CAST(((({_WHOLE}) + 9223372036854775808) % 18446744073709551616 + 18446744073709551616) % 18446744073709551616 - 9223372036854775808 AS BIGINT)"


@query("number_fold", FOLD.format(x=OPS, start="CAST(0 AS BIGINT) a", step=_STEP64, out="arg_max(a, rn) AS value"))
def number_fold(spark, sf):
    return objects.fold_numbers(_ops(spark, sf))


@query("number_mul", FOLD.format(x=OPS.replace("FROM events)", "FROM events WHERE event_type IN ('signup', 'view'))"), start="CAST(0 AS BIGINT) a", step=_STEP64, out="arg_max(a, rn) AS value"))
def number_mul(spark, sf):
    return objects.fold_numbers(_ops(spark, sf).filter("op <> 'add'"))


_SEEN = OPS.replace("o AS (", "o0 AS (") + ", o AS (SELECT oid, op, v, row_number() OVER (PARTITION BY oid ORDER BY txn_id = 2, seq) seq FROM o0 WHERE txn_id % 3 = 0 OR txn_id = 2)"


@query("number_get", FOLD.format(x=_SEEN, start="CAST(0 AS BIGINT) a", step=_STEP64, out="arg_max(a, rn) AS value"))
def number_get(spark, sf):
    """What transaction 2 reads: committed operations, then its own."""
    return objects.read_numbers(_ops(spark, sf), _txns(spark, sf), me=2)


@query("number_set", f"WITH {OPS} SELECT oid, arg_max(v, seq) AS value, count(*) AS n FROM o WHERE op = 'set' GROUP BY oid")
def number_set(spark, sf):
    return _ops(spark, sf).filter("op = 'set'").groupBy("oid").agg(F.max_by("v", "seq").alias("value"), F.count("*").alias("n"))


@query("number_add", f"WITH {OPS} SELECT oid, seq, CAST(sum(v) OVER (PARTITION BY oid ORDER BY seq) AS BIGINT) AS value FROM o WHERE op = 'add'")
def number_add(spark, sf):
    return objects.running_sum(_ops(spark, sf).filter("op = 'add'")).select("oid", "seq", "value")


@query("number_inc_dec", "SELECT user_id AS oid, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END) AS BIGINT) AS value FROM events GROUP BY user_id")
def number_inc_dec(spark, sf):
    step = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("oid")).agg(F.sum(step).alias("value"))


@query("number_cas", FOLD.format(x="o AS (SELECT user_id oid, event_id seq, CAST(floor(value) AS BIGINT) % 3 AS old, (CAST(floor(value) AS BIGINT) + 1) % 3 AS new FROM events)", start="CAST(0 AS BIGINT) a, CAST(0 AS BIGINT) d", step="CASE WHEN f.a = n.old THEN n.new ELSE f.a END, CASE WHEN f.a = n.old THEN f.d + 1 ELSE f.d END", out="arg_max(a, rn) AS value, max(d) AS done"))
def number_cas(spark, sf):
    v = F.floor("value").cast("long")
    return objects.fold_cas(table(spark, sf, "events").select(F.col("user_id").alias("oid"), F.col("event_id").alias("seq"), (v % 3).alias("old"), ((v + 1) % 3).alias("new")))


@query("number_divmod", "SELECT event_id, (CAST(floor(value) AS BIGINT) - 40) // nullif(user_id % 5, 0) AS q, (CAST(floor(value) AS BIGINT) - 40) % nullif(user_id % 5, 0) AS r, CASE WHEN user_id % 5 = 0 THEN 'DIVISION_BY_ZERO' ELSE 'OK' END AS status FROM events")
def number_divmod(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_id", "(CAST(floor(value) AS BIGINT) - 40) div nullif(user_id % 5, 0) AS q", "(CAST(floor(value) AS BIGINT) - 40) % nullif(user_id % 5, 0) AS r",
        "CASE WHEN user_id % 5 = 0 THEN 'DIVISION_BY_ZERO' ELSE 'OK' END AS status",
    )


# -- deques ---------------------------------------------------------------------------------------------------

_MOVES = {"signup": "push_front", "purchase": "push_back", "click": "push_back", "view": "pop_front", "error": "pop_back"}
_MOVE_SQL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _MOVES.items()) + " END"
_DEQUE_STEP = """CASE n.op WHEN 'push_front' THEN list_prepend(n.seq, f.a) WHEN 'push_back' THEN list_append(f.a, n.seq)
  WHEN 'pop_front' THEN f.a[2:] ELSE f.a[:len(f.a)-1] END,
  CASE WHEN n.op LIKE 'push%' THEN f.p WHEN n.op = 'pop_front' THEN list_append(f.p, {'seq': n.seq, 'v': f.a[1]}) ELSE list_append(f.p, {'seq': n.seq, 'v': f.a[len(f.a)]}) END"""

for _name, _used in {
    "deque_fold": tuple(_MOVES.values()), "deque_push_back": ("push_back",), "deque_push_front": ("push_front",),
    "deque_pop_front": ("push_back", "pop_front"), "deque_pop_back": ("push_back", "push_front", "pop_back"),
}.items():

    def _deque(spark, sf, used=_used):
        op = F.create_map(*[F.lit(x) for kv in _MOVES.items() for x in kv])[F.col("event_type")]
        log = table(spark, sf, "events").select(F.col("user_id").alias("oid"), F.col("event_id").alias("seq"), op.alias("op"), F.col("event_id").alias("v"))
        left, popped = objects.fold_deques(log.filter(F.col("op").isin(*used)))
        return left.select("oid", F.lit("left").alias("kind"), "v").unionByName(popped.select("oid", F.concat(F.lit("pop "), F.col("seq").cast("string")).alias("kind"), "v"))

    query(
        _name,
        FOLD.format(
            x=f"o AS (SELECT user_id oid, event_id seq, {_MOVE_SQL} op FROM events WHERE {_MOVE_SQL} IN ({', '.join(repr(u) for u in dict.fromkeys(_used))}))",
            start="CAST([] AS BIGINT[]) a, CAST([] AS STRUCT(seq BIGINT, v BIGINT)[]) p", step=_DEQUE_STEP, out="arg_max(a, rn) AS items, arg_max(p, rn) AS popped",
        ).replace("SELECT oid, arg_max(a, rn) AS items", ", e AS (SELECT oid, arg_max(a, rn) AS items") + ") SELECT oid, 'left' AS kind, unnest(items) AS v FROM e UNION ALL SELECT oid, 'pop ' || x.seq, x.v FROM (SELECT oid, unnest(popped) AS x FROM e)",
    )(_deque)


# -- flows -----------------------------------------------------------------------------------------------------


def _chunks(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").selectExpr("conv_id AS oid", "turn AS seq", "text AS data")


FLOW = "c AS (SELECT conv_id AS oid, coalesce(string_agg(text, '' ORDER BY turn), '') AS data FROM conversations GROUP BY conv_id)"


@query("flow_append", "SELECT conv_id AS oid, turn AS seq, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM conversations")
def flow_append(spark, sf):
    return objects.flow_offsets(_chunks(spark, sf)).select("oid", "seq", "offset")


@query("flow_read", f"WITH {FLOW} SELECT oid, substring(data, 101, 300) AS data FROM c WHERE length(data) > 100")
def flow_read(spark, sf):
    return objects.flow_read_range(_chunks(spark, sf), 100, 300)


for _name, _f, _sql in (
    ("flow_inject", lambda c: objects.flow_inject(c, 10, "<<x>>"), "left(data, 10) || '<<x>>' || substring(data, 11)"),
    ("flow_write", lambda c: objects.flow_write(c, 10, "<<x>>"), "left(data, 10) || '<<x>>' || substring(data, 16)"),
    ("flow_remove", lambda c: objects.flow_remove(c, 10, 20), "left(data, 10) || substring(data, 31)"),
    ("flow_truncate", lambda c: objects.flow_truncate(c, 50), "left(data, 50)"),
):
    query(_name, f"WITH {FLOW} SELECT oid, {_sql} AS data FROM c")(lambda spark, sf, f=_f: objects.flow_contents(f(_chunks(spark, sf))))


# -- bitmaps ---------------------------------------------------------------------------------------------------


def _bits(spark, sf) -> DataFrame:
    return table(spark, sf, "events").filter("event_type = 'click'").selectExpr("user_id AS oid", "event_id % 64 AS bit")


BITS = "b AS (SELECT user_id AS oid, event_id % 64 AS bit FROM events WHERE event_type = 'click')"
RANGE = "r AS (SELECT DISTINCT oid, CAST(x AS BIGINT) AS bit FROM b, range(8, 24) t(x))"


@query("bitmap_test", f"WITH {BITS} SELECT oid, count(DISTINCT CASE WHEN bit >= 3 AND bit < 5 THEN bit END) = 2 AS all_set FROM b GROUP BY oid")
def bitmap_test(spark, sf):
    return objects.bits_set(_bits(spark, sf), 3, 2)


@query("bitmap_find", f"WITH {BITS} SELECT oid, min(bit) AS bit FROM b WHERE bit >= 30 GROUP BY oid")
def bitmap_find(spark, sf):
    return objects.first_bit(_bits(spark, sf), 30)


@query("bitmap_mark", f"WITH {BITS}, {RANGE} SELECT oid, bit FROM b UNION SELECT oid, bit FROM r")
def bitmap_mark(spark, sf):
    return objects.mark(_bits(spark, sf), 8, 16)


@query("bitmap_invert", f"WITH {BITS}, {RANGE}, u AS (SELECT DISTINCT oid, bit FROM b UNION ALL SELECT oid, bit FROM r) SELECT oid, bit FROM u GROUP BY oid, bit HAVING count(*) = 1")
def bitmap_invert(spark, sf):
    return objects.invert(_bits(spark, sf), 8, 16)


@query("bitmap_resize", f"WITH {BITS} SELECT DISTINCT oid, bit FROM b WHERE bit < 32")
def bitmap_resize(spark, sf):
    return _bits(spark, sf).filter("bit < 32").distinct()


# -- names and transactions ------------------------------------------------------------------------------------------


def _names(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").selectExpr("c_name AS name", "c_custkey AS oid")


def _asked(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.concat(F.lit("Customer#"), F.lpad((F.col("event_id") % 700 * 3).cast("string"), 9, "0")).alias("name"), F.col("event_id").alias("seq"))


ASKED = "q AS (SELECT 'Customer#' || lpad(CAST(event_id % 700 * 3 AS VARCHAR), 9, '0') AS name, event_id AS seq FROM events)"


@query("ns_create", f"WITH {ASKED} SELECT q.name, q.seq, CASE WHEN c.c_name IS NULL AND row_number() OVER (PARTITION BY q.name ORDER BY q.seq) = 1 THEN 'OK' ELSE 'OBJECT_EXISTS' END AS status FROM q LEFT JOIN customer c ON c.c_name = q.name")
def ns_create(spark, sf):
    return objects.create_names(_names(spark, sf), _asked(spark, sf))


@query("ns_open", f"WITH {ASKED} SELECT q.name, c.c_custkey AS oid, CASE WHEN c.c_name IS NULL THEN 'OBJECT_NOT_FOUND' ELSE 'OK' END AS status FROM q LEFT JOIN customer c ON c.c_name = q.name")
def ns_open(spark, sf):
    return objects.open_names(_names(spark, sf), _asked(spark, sf)).select("name", "oid", "status")


@query("ns_delete", f"WITH {ASKED} SELECT c_name AS name, c_custkey AS oid FROM customer WHERE c_name NOT IN (SELECT name FROM q)")
def ns_delete(spark, sf):
    return _names(spark, sf).join(_asked(spark, sf), "name", "left_anti")


@query("ns_rename", f"WITH {ASKED} SELECT CASE WHEN c_name IN (SELECT name FROM q) THEN 'New' || c_name ELSE c_name END AS name, c_custkey AS oid FROM customer")
def ns_rename(spark, sf):
    to = _asked(spark, sf).select("name").distinct().select("name", F.concat(F.lit("New"), "name").alias("to"))
    return _names(spark, sf).join(to, "name", "left").select(F.coalesce("to", "name").alias("name"), "oid")


def _txn_log(spark, sf) -> DataFrame:
    return table(spark, sf, "events").selectExpr("event_id AS seq", "event_id % 10 AS txn_id", "user_id AS oid", "event_type AS key", "floor(value) AS value")


def _txns(spark, sf) -> DataFrame:
    return spark.range(1, 10).selectExpr("id AS txn_id", "CASE id % 3 WHEN 0 THEN 'COMMITTED' WHEN 1 THEN 'ROLLEDBACK' ELSE 'WAIT_COMMIT' END AS state")


LOG = "l AS (SELECT event_id AS seq, event_id % 10 AS txn_id, user_id AS oid, event_type AS key, CAST(floor(value) AS BIGINT) AS value FROM events)"


@query("txn_committed_read", f"WITH {LOG} SELECT oid, key, arg_max(value, seq) AS value FROM l WHERE txn_id % 3 = 0 GROUP BY oid, key")
def txn_committed_read(spark, sf):
    return objects.visible(_txn_log(spark, sf), _txns(spark, sf))


@query("txn_own_read", f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY oid, key ORDER BY (txn_id = 2) DESC, seq DESC) rn FROM l WHERE txn_id % 3 = 0 OR txn_id = 2) SELECT oid, key, value FROM r WHERE rn = 1")
def txn_own_read(spark, sf):
    return objects.visible(_txn_log(spark, sf), _txns(spark, sf), me=2)


@query("txn_rollback", f"WITH {LOG}, u AS (SELECT oid, key, count(*) AS undone FROM l WHERE txn_id % 3 = 1 GROUP BY oid, key), k AS (SELECT oid, key, arg_max(value, seq) AS value FROM l WHERE txn_id % 3 = 0 GROUP BY oid, key) SELECT u.oid, u.key, u.undone, k.value FROM u LEFT JOIN k ON u.oid = k.oid AND u.key = k.key")
def txn_rollback(spark, sf):
    return objects.rolled_back(_txn_log(spark, sf), _txns(spark, sf))


_HOLD = "f.t IS NULL OR (f.r IS NOT NULL AND f.r < n.seq)"


@query(
    "txn_lock_conflicts",
    f"""WITH RECURSIVE l AS (SELECT event_id AS seq, user_id % 7 AS txn_id, CASE event_type WHEN 'purchase' THEN 'commit' WHEN 'error' THEN 'rollback' ELSE 'write' END AS op, event_id % 5 AS oid, event_type AS key FROM events),
o AS (SELECT w.seq, w.txn_id, w.oid, w.key, min(e.seq) AS r FROM l w LEFT JOIN l e ON e.op <> 'write' AND e.txn_id = w.txn_id AND e.seq > w.seq WHERE w.op = 'write' GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY oid, key ORDER BY seq) AS rn FROM o),
f AS (SELECT DISTINCT oid, key, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS t, CAST(NULL AS BIGINT) AS r, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS txn_id FROM n
UNION ALL SELECT f.oid, f.key, n.rn, CASE WHEN {_HOLD} THEN n.txn_id ELSE f.t END, CASE WHEN {_HOLD} THEN n.r ELSE f.r END, n.seq, n.txn_id FROM f JOIN n ON n.oid = f.oid AND n.key = f.key AND n.rn = f.rn + 1)
SELECT seq, txn_id, t AS owner FROM f WHERE txn_id <> t""",
)
def txn_lock_conflicts(spark, sf):
    op = F.when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "error", "rollback").otherwise("write")
    log = table(spark, sf, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 7).alias("txn_id"), op.alias("op"), (F.col("event_id") % 5).alias("oid"), F.col("event_type").alias("key"))
    return objects.conflicts(log)


# -- tables --------------------------------------------------------------------------------------------------------


def _region(spark, sf) -> DataFrame:
    return table(spark, sf, "region")


R = "SELECT r_regionkey, r_name FROM region UNION ALL "
query("dml_insert_values", R + "SELECT 90, 'ATLANTIS'")(lambda spark, sf: tables.insert_rows(_region(spark, sf), [(90, "ATLANTIS")], ["r_regionkey", "r_name"]))
query("dml_insert_positional", R + "SELECT 91, 'MU'")(lambda spark, sf: tables.insert_rows(_region(spark, sf), [(91, "MU")]))
query("dml_insert_default", R + "SELECT NULL, 'none'")(lambda spark, sf: tables.insert_default(_region(spark, sf), {"r_name": "none"}))
query("dml_insert_select", R + "SELECT n_nationkey + 100, n_name FROM nation")(lambda spark, sf: _region(spark, sf).unionByName(table(spark, sf, "nation").selectExpr("n_nationkey + 100 AS r_regionkey", "n_name AS r_name")))
_NEW = "SELECT n_nationkey AS r_regionkey, n_name AS r_name FROM nation WHERE n_nationkey BETWEEN 3 AND 8"


def _new(spark, sf) -> DataFrame:
    return table(spark, sf, "nation").filter("n_nationkey BETWEEN 3 AND 8").selectExpr("n_nationkey AS r_regionkey", "n_name AS r_name")


query("dml_upsert_replace", f"WITH n AS ({_NEW}) SELECT * FROM region WHERE r_regionkey NOT IN (SELECT r_regionkey FROM n) UNION ALL SELECT * FROM n")(lambda spark, sf: tables.upsert(_region(spark, sf), _new(spark, sf), ["r_regionkey"]))
query("dml_upsert_ignore", f"WITH n AS ({_NEW}) SELECT * FROM region UNION ALL SELECT * FROM n WHERE r_regionkey NOT IN (SELECT r_regionkey FROM region)")(lambda spark, sf: tables.upsert(_region(spark, sf), _new(spark, sf), ["r_regionkey"], replace=False))
query("dml_merge", f"WITH n AS ({_NEW}) SELECT coalesce(n.r_regionkey, r.r_regionkey) AS r_regionkey, coalesce(n.r_name, r.r_name) AS r_name FROM region r FULL JOIN n ON n.r_regionkey = r.r_regionkey")(lambda spark, sf: tables.merge(_region(spark, sf), _new(spark, sf), ["r_regionkey"]))
query("dml_update", "SELECT p_partkey, CASE WHEN p_size > 20 THEN p_size * 10 ELSE p_size END AS p_size FROM part")(lambda spark, sf: tables.update(table(spark, sf, "part"), F.col("p_size") > 20, p_size=F.col("p_size") * 10).select("p_partkey", "p_size"))
query("dml_delete", "SELECT c_custkey FROM customer WHERE NOT coalesce(c_acctbal > 3000, false)")(lambda spark, sf: tables.delete(table(spark, sf, "customer"), F.col("c_acctbal") > 3000).select("c_custkey"))
query("ddl_add_column", "SELECT r_regionkey, r_name, CAST(NULL AS INTEGER) AS a FROM region")(lambda spark, sf: tables.add_column(_region(spark, sf), "a", "int"))
query("ddl_drop_column", "SELECT n_nationkey, n_name FROM nation")(lambda spark, sf: table(spark, sf, "nation").drop("n_regionkey"))


@query("ddl_create", "SELECT 1 AS key, 'a' AS value UNION ALL SELECT 2, 'b'")
def ddl_create(spark, sf):
    s = tables.Session(spark)
    s.create("foo", "key int, value string")
    s.begin()
    s.put("foo", tables.insert_rows(s.tables["foo"], [(1, "a"), (2, "b")]))
    s.savepoint("two")
    s.put("foo", tables.delete(s.tables["foo"], F.col("key") == 1))
    s.rollback("two")
    s.commit()
    return s.sql("SELECT key, value FROM {foo}")


query("constraint_check", "SELECT c_custkey, c_acctbal FROM customer WHERE NOT (c_acctbal >= 0)")(lambda spark, sf: tables.not_checked(table(spark, sf, "customer"), F.col("c_acctbal") >= 0).select("c_custkey", "c_acctbal"))
query("constraint_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")(lambda spark, sf: tables.not_unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]))
query("constraint_not_null", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")(lambda spark, sf: table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").filter("quality IS NULL").select("doc_id"))
query("constraint_fk", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")(lambda spark, sf: tables.without_parent(table(spark, sf, "orders"), table(spark, sf, "customer").filter("c_acctbal > 0"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey"))

# -- groups, histograms, series -----------------------------------------------------------------------------------------


@query("group_cluster", "SELECT n_regionkey, array_to_string(list(n_name ORDER BY n_nationkey), ',') AS names FROM nation GROUP BY n_regionkey")
def group_cluster(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(rows, lambda x: x["n_name"]), ",").alias("names"))


#: Upper bounds of the histogram's buckets; fixed values.
BOUNDS = (5, 10, 20, 50, 75, 100, 150, 200, 300)
_BUCKET = "CASE " + " ".join(f"WHEN value <= {b} THEN {k}" for k, b in enumerate(BOUNDS)) + f" ELSE {len(BOUNDS)} END"
_PERCENTILE = f"""WITH h AS (SELECT {_BUCKET} AS bucket, count(*) AS n, max(value) AS top FROM events GROUP BY 1),
c AS (SELECT *, sum(n) OVER (ORDER BY bucket) AS cum, sum(n) OVER () AS total, coalesce(CASE bucket {' '.join(f'WHEN {k} THEN {b}.0' for k, b in enumerate(BOUNDS))} END, top) AS edge FROM h)
SELECT CAST(share AS INTEGER) AS share, CAST(min(edge) AS DOUBLE) AS bound FROM c, (VALUES {{}}) s(share) WHERE cum * 100 >= total * share GROUP BY share"""
query("hist_buckets", f"SELECT {_BUCKET} AS bucket, count(*) AS n FROM events GROUP BY 1")(lambda spark, sf: metrics.histogram(table(spark, sf, "events"), "value", BOUNDS).select("bucket", "n"))
query("hist_percentile", _PERCENTILE.format("(25), (90), (99), (100)"))(lambda spark, sf: metrics.histogram_percentile(table(spark, sf, "events"), "value", BOUNDS, (25, 90, 99, 100)))
query("hist_median", _PERCENTILE.format("(50)"))(lambda spark, sf: metrics.histogram_percentile(table(spark, sf, "events"), "value", BOUNDS, (50,)))


#: Upper bounds of I/O latencies in microseconds; fixed values.
LATENCIES = (5, 10, 20, 50, 1_000, 5_000, 10_000, 25_000, 50_000, 100_000, 250_000, 500_000, 1_000_000, 2_000_000, 5_000_000, 10_000_000)
query("hist_io_latency", "SELECT CASE " + " ".join(f"WHEN value * value * 100 <= {b} THEN {k}" for k, b in enumerate(LATENCIES)) + f" ELSE {len(LATENCIES)} END AS bucket, count(*) AS n FROM events GROUP BY 1")(
    lambda spark, sf: metrics.histogram(table(spark, sf, "events").withColumn("us", F.col("value") * F.col("value") * 100), "us", LATENCIES).select("bucket", "n")
)


@query("hist_stats", "SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, round(coalesce(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / nullif(count(*), 0), 0), 6) AS average FROM events GROUP BY event_type")
def hist_stats(spark, sf):
    total = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), total.alias("total"), F.round(F.coalesce(total / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 6).alias("average"))


query("window_lag_delta", "WITH d AS (SELECT user_id, event_id, CAST(CAST(value AS DECIMAL(18,2)) - lag(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS delta, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, delta FROM d WHERE rn > 2")(
    lambda spark, sf: metrics.deltas(table(spark, sf, "events").withColumn("value", F.col("value").cast("decimal(18,2)")), "user_id", "event_id", "value").select("user_id", "event_id", F.col("delta").cast("double").alias("delta"))
)
query("window_last_n", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) rn FROM events) WHERE rn <= 20")(lambda spark, sf: metrics.last_n(table(spark, sf, "events"), "user_id", "event_id", 20).select("user_id", "event_id"))
query("monitor_to_json", "SELECT event_id, '{\"user\":' || user_id || ',\"type\":\"' || event_type || '\"}' AS json FROM events")(lambda spark, sf: table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type"))).alias("json")))

# -- functions -------------------------------------------------------------------------------------------------------------


def _over(name: str, source: str, key: str, out: str, make, sql: str | None = None):
    query(name, sql)(lambda spark, sf: table(spark, sf, source).select(key, make().alias(out)))


_N = "CAST(floor(o_totalprice * o_orderkey) AS HUGEINT)"
#: A number of units with two digits, halves rounded up.
_UNITS = lambda size, unit: f"WHEN n >= {size} THEN (2 * n * 100 + {size}) // {2 * size} // 100 || '.' || lpad(CAST((2 * n * 100 + {size}) // {2 * size} % 100 AS VARCHAR), 2, '0') || '{unit}'"
_over("fn_human_size", "orders", "o_orderkey", "size", lambda: scalars.human_size((F.col("o_totalprice") * F.col("o_orderkey")).cast("long")), f"SELECT o_orderkey, CASE {' '.join(_UNITS(1 << 10 * k, u) for k, u in reversed(list(enumerate(scalars.SIZES, 1))))} ELSE n || 'bytes' END AS size FROM (SELECT o_orderkey, {_N} AS n FROM orders)")
_over("fn_human_time", "orders", "o_orderkey", "time", lambda: scalars.human_time((F.col("o_totalprice") * F.col("o_orderkey")).cast("long")), f"SELECT o_orderkey, CASE {' '.join(_UNITS(k, u) for k, u in reversed(scalars.TIMES))} ELSE n || 'usec' END AS time FROM (SELECT o_orderkey, {_N} AS n FROM orders)")
_over("fn_parse_int_base", "part", "p_partkey", "n", lambda: scalars.parse_int(F.concat(F.lit(" -"), F.hex("p_partkey"), F.lit("zz")), 16), "SELECT p_partkey, -p_partkey AS n FROM part")
_over("fn_zigzag", "part", "p_partkey", "z", lambda: scalars.zigzag(F.col("p_size").cast("long") - 25), "SELECT p_partkey, CAST(CASE WHEN p_size < 25 THEN -2 * (p_size - 25) - 1 ELSE 2 * (p_size - 25) END AS BIGINT) AS z FROM part")
_CASES = lambda bits, most: "CASE " + " ".join(f"WHEN v < CAST({1 << bits * k} AS HUGEINT) THEN {k}" for k in range(1, most)) + f" ELSE {most} END"
_over("fn_varint_size", "orders", "o_orderkey", "n", lambda: scalars.varint_size(F.col("o_orderkey") * F.col("o_custkey") * 1000), f"SELECT o_orderkey, {_CASES(7, 9)} AS n FROM (SELECT o_orderkey, o_orderkey * o_custkey * 1000 AS v FROM orders)")
_over("fn_uint_bytes", "orders", "o_orderkey", "n", lambda: scalars.uint_bytes(F.col("o_orderkey") * F.col("o_custkey") * 1000), f"SELECT o_orderkey, {_CASES(8, 8)} AS n FROM (SELECT o_orderkey, o_orderkey * o_custkey * 1000 AS v FROM orders)")
_SHARED = "SELECT p_partkey, CAST(CASE WHEN n = 0 THEN 0 ELSE coalesce(nullif(list_position(list_transform(range(1, n + 1), lambda i: substr(a, i, 1) = substr(b, i, 1)), false), 0), n + 1) - 1 END AS INTEGER) AS n FROM (SELECT p_partkey, {0} AS a, {1} AS b, least(length(p_name), length(p_type)) AS n FROM part)"
_over("fn_shared_prefix", "part", "p_partkey", "n", lambda: scalars.shared_prefix(F.upper("p_name"), F.col("p_type")), _SHARED.format("upper(p_name)", "p_type"))
_over("fn_shared_suffix", "part", "p_partkey", "n", lambda: scalars.shared_suffix(F.upper("p_name"), F.col("p_type")), _SHARED.format("reverse(upper(p_name))", "reverse(p_type)"))
_M = "& 4294967295"
_STEP = {
    "js": f"xor(h, ((h << 5) + c + (h >> 2)) {_M})", "sdbm": f"(c + (h << 6) + (h << 16) - h) {_M}", "dek": f"xor(xor((h << 5) {_M}, h >> 27), c)",
    "djb": f"(h * 33 + c) {_M}", "fnv": f"xor((h * 2166136261) {_M}, c)", "x31": f"(h * 31 + c) {_M}",
    "elf": f"xor(((h << 4) + c) {_M}, (((h << 4) + c) & 4026531840) >> 23) & 268435455",
}
for _kind_, _step_ in _STEP.items():
    _over(
        f"udf_hash_{_kind_}", "customer", "c_custkey", "h", lambda k=_kind_: hashes.rolling(k, 5)(F.col("c_name")),
        f"SELECT c_custkey, CAST(list_reduce(list_prepend(CAST(5 AS HUGEINT), list_transform(range(1, length(c_name) + 1), lambda i: CAST(unicode(substr(c_name, i, 1)) AS HUGEINT))), lambda h, c: CAST({_step_} AS HUGEINT)) AS BIGINT) AS h FROM customer",
    )
_BYTES = "list_transform(range(1, length(c_name) + 1), lambda i: CAST(unicode(substr(c_name, i, 1)) AS HUGEINT))"
_ROT = lambda x, k: f"((({x} << {k}) | ({x} >> {32 - k})) {_M})"
_MIXED = f"list_transform(list_transform(list_transform({{}}, lambda k: (k * 3432918353) {_M}), lambda k: {_ROT('k', 15)}), lambda k: (k * 461845907) {_M})"
_over(
    "udf_murmur3", "customer", "c_custkey", "h", lambda: hashes.murmur3(42)(F.col("c_name")),
    f"""WITH b AS (SELECT c_custkey, {_BYTES} AS b FROM customer),
w AS (SELECT c_custkey, len(b) AS n, {_MIXED.format("list_transform(range(0, len(b) // 4), lambda i: b[4*i+1] + b[4*i+2] * 256 + b[4*i+3] * 65536 + b[4*i+4] * 16777216)")} AS k,
  {_MIXED.format("[coalesce(b[len(b)//4*4+1], 0) + coalesce(b[len(b)//4*4+2], 0) * 256 + coalesce(b[len(b)//4*4+3], 0) * 65536]")}[1] AS rest FROM b),
r AS (SELECT c_custkey, xor(xor(list_reduce(list_prepend(CAST(42 AS HUGEINT), k), lambda h, k: CAST(({_ROT('xor(h, k)', 13)} * 5 + 3864292196) {_M} AS HUGEINT)), rest), n) AS h FROM w),
x AS (SELECT c_custkey, (xor(h, h >> 16) * 2246822507) {_M} AS h FROM r), y AS (SELECT c_custkey, (xor(h, h >> 13) * 3266489909) {_M} AS h FROM x)
SELECT c_custkey, CAST(xor(h, h >> 16) AS BIGINT) AS h FROM y""",
)
_over("udf_adler32", "customer", "c_custkey", "h", lambda: hashes.adler32(F.col("c_name")), f"WITH b AS (SELECT c_custkey, {_BYTES} AS b FROM customer) SELECT c_custkey, CAST((len(b) + list_sum(list_transform(range(1, len(b) + 1), lambda i: b[i] * (len(b) + 1 - i)))) % 65521 * 65536 + (1 + list_sum(b)) % 65521 AS BIGINT) AS h FROM b")
_over(
    "udf_crc32c", "customer", "c_custkey", "h", lambda: hashes.crc32c(F.col("c_name")),
    f"SELECT c_custkey, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS HUGEINT), flatten(list_transform({_BYTES}, lambda c: [c, 0, 0, 0, 0, 0, 0, 0]))), lambda h, c: CAST(xor(xor(h, c) >> 1, (xor(h, c) & 1) * 2197175160) AS HUGEINT)), 4294967295) AS BIGINT) AS h FROM customer",
)
_LCG = lambda x: f"(({x}) * 1103515245 + 12345) {_M}"
_over(
    "udf_lcg_rand", "customer", "c_custkey", "r", lambda: hashes.lcg_rand(F.col("c_custkey")),
    f"WITH a AS (SELECT c_custkey, {_LCG('CAST(c_custkey AS HUGEINT)')} AS x FROM customer), b AS (SELECT c_custkey, x, {_LCG('x')} AS y FROM a), c AS (SELECT *, {_LCG('y')} AS z FROM b) SELECT c_custkey, CAST(xor(xor(((x >> 16) & 2047) << 10, (y >> 16) & 1023) << 10, (z >> 16) & 1023) AS BIGINT) AS r FROM c",
)


@query("udf_scalar", "SELECT p_partkey, p_size * p_size + 1 AS v FROM part")
def udf_scalar(spark, sf):
    @F.pandas_udf("int")
    def square(x: pd.Series) -> pd.Series:
        return x * x + 1

    spark.udf.register("square_plus_one", square)
    return table(spark, sf, "part").selectExpr("p_partkey", "square_plus_one(p_size) AS v")


query("codec_delta", "SELECT o_custkey, o_orderkey, o_orderkey - coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS d FROM orders")(
    lambda spark, sf: table(spark, sf, "orders").selectExpr("o_custkey", "o_orderkey", "o_orderkey - coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS d")
)


@query("codec_prefix", "SELECT oid, key, CAST(n AS INTEGER) AS shared, substring(key, n + 1) AS rest FROM (SELECT oid, key, CASE WHEN p = '' THEN 0 ELSE coalesce(nullif(list_position(list_transform(range(1, least(length(key), length(p)) + 1), lambda i: substr(key, i, 1) = substr(p, i, 1)), false), 0), least(length(key), length(p)) + 1) - 1 END AS n FROM (SELECT c_nationkey AS oid, c_name AS key, coalesce(lag(c_name) OVER (PARTITION BY c_nationkey ORDER BY c_name), '') AS p FROM customer))")
def codec_prefix(spark, sf):
    own = _set(spark, sf).selectExpr("oid", "key", "coalesce(lag(key) OVER (PARTITION BY oid ORDER BY key), '') AS p")
    own = own.withColumn("shared", scalars.shared_prefix(F.col("key"), F.col("p")))
    return own.selectExpr("oid", "key", "shared", "substring(key, shared + 1) AS rest")


# -- streams (extensions) ------------------------------------------------------------------------------------------------

_WINDOW = "SELECT {} AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events{} GROUP BY ALL"
query("stream_tumbling", _WINDOW.format("date_trunc('hour', ts)", ""))(lambda spark, sf: streams.finish(streams.tumbling(streams.source(spark, sf)), "complete"))
query("stream_sliding", _WINDOW.format("date_trunc('hour', ts) - to_hours(k)", ", range(0, 2) r(k)"))(lambda spark, sf: streams.finish(streams.sliding(streams.source(spark, sf)), "complete"))
query("stream_session", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")(
    lambda spark, sf: streams.finish(streams.sessions(streams.source(spark, sf)), "complete")
)
query("stream_dedup_watermark", "SELECT event_id, user_id FROM events")(lambda spark, sf: streams.finish(streams.first_of_each(streams.source(spark, sf)), "append"))
query("stream_number_state", "SELECT user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END) AS BIGINT) AS value FROM events GROUP BY user_id")(
    lambda spark, sf: streams.finish(streams.numbers(streams.source(spark, sf)), "update", ["user_id"])
)
