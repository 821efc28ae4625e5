"""Relational queries: projection, predicates, joins, grouping, ordering, sets, scalar functions.

``Q`` maps a name to Spark SQL in which tables stand in braces; Catalyst plans it. The same text
without braces is the SQL twin, unless ``TWIN`` gives another for a name where the dialects part.
Money is summed as decimals, so that the order of additions does not matter.
"""

from __future__ import annotations

Q: dict[str, str] = {}
TWIN: dict[str, str] = {}


def money(column: str) -> str:
    return f"CAST(sum(CAST({column} AS DECIMAL(18,2))) AS DOUBLE)"


# -- projection, filter, predicates -----------------------------------------------------------
Q |= {
    "scan_project": "SELECT l_orderkey, l_quantity FROM {lineitem} WHERE l_shipdate < TIMESTAMP '1995-01-01 00:00:00'",
    "select_star": "SELECT * FROM {region}",
    "select_table_star": "SELECT n.* FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey WHERE r.r_name LIKE 'A%'",
    "select_columns": "SELECT c_name, c_mktsegment FROM {customer}",
    "select_expr": "SELECT o_orderkey, CAST(round(o_totalprice * 2 + 1, 2) AS DOUBLE) AS doubled FROM {orders}",
    "select_alias": "SELECT p_partkey AS id, p_size AS size_in_cm FROM {part}",
    "table_alias": "SELECT t.s_suppkey AS k FROM {supplier} AS t WHERE t.s_acctbal > 0",
    "select_constant": "SELECT 10 * 2 AS a, 'x' AS b",
    "filter_where": "SELECT o_orderkey FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE c_acctbal > 5000 AND o_totalprice < 100000",
    "pred_comparison": "SELECT p_partkey FROM {part} WHERE p_size <> 7 AND p_size >= 3 AND p_size <= 40 AND p_retailprice > 905 AND p_retailprice < 1500 AND p_brand = 'Brand#1'",
    "pred_not_less_greater": "SELECT p_partkey, p_size FROM {part} WHERE p_size !< 10 AND p_size !> 20 AND p_size <> 15",
    "pred_boolean": "SELECT p_partkey FROM {part} WHERE (p_size > 10 AND NOT p_size > 20) OR p_brand = 'Brand#3'",
    "pred_is_null": "SELECT d.doc_id, l.quality IS NULL AS unlabelled FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id",
    "pred_between": "SELECT p_partkey FROM {part} WHERE p_size BETWEEN 1 + 2 AND 9",
    "pred_not_between": "SELECT p_partkey FROM {part} WHERE p_size NOT BETWEEN 3 AND 45",
    "pred_in": "SELECT p_partkey FROM {part} WHERE p_size IN (1, 2, 3) AND p_type IN ('ECONOMY', 'PROMO')",
    "pred_not_in": "SELECT p_partkey FROM {part} WHERE p_size NOT IN (1, 2, 3, 4, 5)",
    "pred_like": "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%ring%' AND p_brand LIKE 'Brand#_'",
    "pred_ilike": "SELECT p_partkey, p_name FROM {part} WHERE p_name ILIKE '%RED%'",
    "select_distinct": "SELECT DISTINCT c_mktsegment, c_nationkey FROM {customer}",
    "subquery_scalar": "SELECT p_partkey FROM {part} WHERE p_size > (SELECT avg(p_size) FROM {part})",
    "subquery_from": "SELECT x.seg, x.n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM {customer} GROUP BY c_mktsegment) AS x WHERE x.n > 10",
    "pred_float_similar": "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE abs(l_discount - 0.05D) < 1e-5",
}
TWIN["pred_not_less_greater"] = "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size <= 20 AND p_size <> 15"
TWIN["pred_float_similar"] = "SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_discount - 0.05) < 1e-5"

# -- joins -------------------------------------------------------------------------------------
Q |= {
    "join_cross": "SELECT n_name, r_name FROM {nation} CROSS JOIN {region}",
    "join_comma": "SELECT n_name, r_name FROM {nation}, {region} WHERE n_regionkey = r_regionkey",
    "join_inner_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a INNER JOIN {nation} b ON a.n_nationkey < b.n_nationkey",
    "join_equi": "SELECT o_orderkey, c_name FROM {orders} INNER JOIN {customer} ON o_custkey = c_custkey",
    "join_natural": "SELECT doc_id, lang, quality, toxic FROM {documents} NATURAL JOIN {labels}",
    "join_left": "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 400000",
    "join_right": "SELECT o_orderkey, c_custkey FROM {orders} RIGHT OUTER JOIN {customer} ON c_custkey = o_custkey AND o_orderstatus = 'F'",
    "join_sql_bare": "SELECT s_name, n_name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey",
    "join_using": "SELECT doc_id, source, toxic FROM {documents} JOIN {labels} USING (doc_id)",
    "join_multiway": f"SELECT r_name, count(*) AS n, {money('o_totalprice')} AS total FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey GROUP BY r_name",
    "join_self": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
}

# -- aggregation -------------------------------------------------------------------------------
Q |= {
    "group_multi_key": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS quantity FROM {lineitem} GROUP BY l_returnflag, l_linestatus",
    "group_having": "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12",
    "group_filtered": f"SELECT o_orderpriority, {money('o_totalprice')} AS total FROM {{orders}} WHERE o_orderstatus = 'O' GROUP BY o_orderpriority",
    "agg_count": "SELECT count(*) AS n, count(quality) AS labelled FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id",
    "agg_count_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers FROM {lineitem} GROUP BY l_returnflag",
    "agg_sum_min_max": f"SELECT c_mktsegment, {money('c_acctbal')} AS total, min(c_acctbal) AS low, max(c_acctbal) AS high FROM {{customer}} GROUP BY c_mktsegment",
    "agg_percentile": "SELECT c_mktsegment, round(percentile(c_acctbal, 0.9), 4) AS p90 FROM {customer} GROUP BY c_mktsegment",
    "fn_sum_variadic": "SELECT p_partkey, p_size + p_partkey + 3 AS total FROM {part}",
    "fn_least": "SELECT p_partkey, least(p_size, p_partkey, 25) AS low FROM {part}",
    "fn_greatest": "SELECT p_partkey, greatest(p_size, p_partkey, 25) AS high FROM {part}",
}
TWIN["agg_count_distinct"] = "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag"
TWIN["group_multi_key"] = "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus"
TWIN["agg_percentile"] = "SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.9), 4) AS p90 FROM customer GROUP BY c_mktsegment"

# -- windows, ordering, limits, sets -------------------------------------------------------------
Q |= {
    "window_rank": "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS place FROM {events}",
    "map_prev_next": "SELECT c_nationkey, c_name, lag(c_name) OVER (PARTITION BY c_nationkey ORDER BY c_name) AS prev, lead(c_name) OVER (PARTITION BY c_nationkey ORDER BY c_name) AS next FROM {customer}",
    "sort_multi_key": "SELECT o_orderpriority, o_orderdate, o_orderkey FROM {orders} ORDER BY o_orderpriority ASC NULLS FIRST, o_orderdate DESC NULLS LAST, o_orderkey",
    "group_sort_within": "SELECT c_mktsegment, c_acctbal, c_custkey FROM {customer} ORDER BY c_mktsegment, c_acctbal DESC, c_custkey",
    "limit_offset": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 20",
    "top_n": "SELECT p_partkey, p_retailprice FROM {part} ORDER BY p_retailprice DESC, p_partkey LIMIT 7",
    "topk": "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_acctbal DESC, c_custkey LIMIT 100",
    "map_skip_n": "SELECT c_name FROM {customer} ORDER BY c_name LIMIT 50 OFFSET 100",
    "map_size": "SELECT c_nationkey AS oid, count(DISTINCT c_name) AS n FROM {customer} GROUP BY c_nationkey",
    "setop_union": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "setop_union_all": "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}",
    "setop_intersect": "SELECT o_custkey AS k FROM {orders} INTERSECT SELECT c_custkey FROM {customer}",
    "setop_except": "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders}",
    "setop_intersect_all": "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}",
    "setop_except_all": "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}",
}

# -- scalar functions ----------------------------------------------------------------------------
Q |= {
    "expr_arith": "SELECT p_partkey, round(p_retailprice + 2 - p_size * 3, 4) AS a, round(p_size / 7, 6) AS b FROM {part}",
    "fn_concat": "SELECT p_partkey, p_brand || '-' || p_type AS label FROM {part}",
    "expr_mod": "SELECT p_partkey, (p_size - 25) % 7 AS m FROM {part}",
    "fn_pmod": "SELECT p_partkey, pmod(p_size - 25, 7) AS m FROM {part}",
    "expr_int_div": "SELECT p_partkey, CAST((p_size - 25) div 7 AS BIGINT) AS q FROM {part}",
    "expr_bitwise": "SELECT p_partkey, p_size & 12 AS a, p_size | 12 AS o, p_size ^ 12 AS x FROM {part}",
    "expr_bitnot": "SELECT p_partkey, ~p_size AS n FROM {part}",
    "expr_shift": "SELECT p_partkey, p_size << 3 AS l, p_size >> 2 AS r FROM {part}",
    "expr_unary": "SELECT p_partkey, -p_size AS minus, +p_size AS plus FROM {part}",
    "fn_abs": "SELECT c_custkey, abs(c_acctbal) AS a FROM {customer}",
    "fn_trig": "SELECT p_partkey, round(sin(p_size), 6) AS s, round(cos(p_size), 6) AS c, round(tan(p_size), 6) AS t, round(asin(p_size / 100), 6) AS asn, round(acos(p_size / 100), 6) AS acs, round(atan(p_size), 6) AS atn FROM {part}",
    "fn_ceil_floor": "SELECT c_custkey, CAST(ceil(c_acctbal) AS DOUBLE) AS up, CAST(floor(c_acctbal) AS DOUBLE) AS down FROM {customer}",
    "fn_exp_log_sqrt": "SELECT p_partkey, round(exp(p_size / 10), 5) AS e, round(ln(p_size + 1), 6) AS l, round(sqrt(p_size), 6) AS r FROM {part}",
    "fn_random": "SELECT p_partkey, rand() AS r FROM {part}",
    "fn_constants": "SELECT round(pi(), 10) AS pi, TRUE AS t, FALSE AS f, CAST(NULL AS INT) AS n",
    "fn_upper_lower": "SELECT p_partkey, upper(substring(p_name, 1, 4)) AS u, lower(p_brand) AS l FROM {part}",
    "fn_casecmp": "SELECT p_partkey, lower(p_name) = lower('RED ring') AS same FROM {part}",
    "fn_instr": "SELECT p_partkey, CAST(instr(p_name, 'in') AS BIGINT) AS at FROM {part}",
    "fn_parse_int": "SELECT c_custkey, try_cast(substring(c_name, 10) AS BIGINT) AS n, try_cast(c_mktsegment AS BIGINT) AS none FROM {customer}",
    "fn_format_int": "SELECT p_partkey, lower(hex(p_partkey)) AS h, bin(p_partkey) AS b FROM {part}",
    "fn_bytewise_order": "SELECT a.p_brand AS a, b.p_brand AS b, a.p_brand < b.p_brand AS less FROM (SELECT DISTINCT p_brand FROM {part}) a CROSS JOIN (SELECT DISTINCT p_brand FROM {part}) b",
    "fn_sha1": "SELECT c_custkey, sha1(c_name) AS h FROM {customer}",
    "fn_sha256": "SELECT c_custkey, sha2(c_name, 256) AS h FROM {customer}",
    "fn_epoch_micros": "SELECT event_id, unix_micros(CAST(ts AS TIMESTAMP)) AS us FROM {events}",
    "fn_date_format": "SELECT event_id, date_format(ts, 'dd-MMM-yy-HH:mm:ss') AS d FROM {events}",
    "fn_scale_down": "SELECT p_partkey, round(p_size * 20 / 50, 6) AS scaled FROM {part}",
    "fn_date_literal": "SELECT o_orderkey FROM {orders} WHERE o_orderdate >= DATE '1998-01-01'",
    "fn_ilog2": "SELECT p_partkey, CASE WHEN p_size <= 1 THEN 0 ELSE length(bin(p_size - 1)) END AS l FROM {part}",
}
TWIN |= {
    "fn_pmod": "SELECT p_partkey, (((p_size - 25) % 7) + 7) % 7 AS m FROM part",
    "expr_int_div": "SELECT p_partkey, CAST((p_size - 25) // 7 AS BIGINT) AS q FROM part",
    "expr_bitwise": "SELECT p_partkey, p_size & 12 AS a, p_size | 12 AS o, xor(p_size, 12) AS x FROM part",
    "fn_parse_int": "SELECT c_custkey, try_cast(substring(c_name, 10) AS BIGINT) AS n, try_cast(c_mktsegment AS BIGINT) AS none FROM customer",
    "fn_sha256": "SELECT c_custkey, sha256(c_name) AS h FROM customer",
    "fn_epoch_micros": "SELECT event_id, epoch_us(ts) AS us FROM events",
    "fn_date_format": "SELECT event_id, strftime(ts, '%d-%b-%y-%H:%M:%S') AS d FROM events",
    "fn_ilog2": "SELECT p_partkey, CASE WHEN p_size <= 1 THEN 0 ELSE CAST(length(bin(p_size - 1)) AS INTEGER) END AS l FROM part",
}
#: Without a twin: random numbers differ.
ROWS_ONLY = {"fn_random"}
