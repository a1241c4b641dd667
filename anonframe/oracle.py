"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations


def gen_sql(rels: list[tuple[str, str, str]], k: int, hosts: int = 2, where: tuple[str, ...] = (), parity: bool = False) -> str:
    """CTEs ending in ``m(key, gen)``: prefix sums, next pointers by ASOF join, and a recursive walk.

    rels: (table, key, host expression).  Strict form, criterion 'range'.
    """
    where = where or ("TRUE",) * len(rels)
    counts = " UNION ALL ".join(f"SELECT {i} AS rel, {key} AS key, CAST({host} % {hosts} AS INT) AS host, count(*) AS n FROM {table} WHERE {cond} GROUP BY ALL" for i, ((table, key, host), cond) in enumerate(zip(rels, where, strict=True)))
    return f"""WITH RECURSIVE c AS ({counts}),
tot AS (SELECT rel, key, sum(n) AS n FROM c GROUP BY rel, key),
dom AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS idx FROM tot GROUP BY key HAVING count(*) = {len(rels)}),
h AS (SELECT unnest(range({hosts})) AS host),
v AS (SELECT t.rel, h.host, d.idx, CASE WHEN t.n = coalesce(c.n, 0) THEN t.n ELSE t.n - coalesce(c.n, 0) END AS own, t.n AS total, coalesce(c.n, 0) AS mine
  FROM tot t JOIN dom d USING (key) CROSS JOIN h LEFT JOIN c ON c.rel = t.rel AND c.key = t.key AND c.host = h.host),
o AS (SELECT rel, host, idx, CASE WHEN total = mine THEN total ELSE total - mine END AS x FROM v),
p AS (SELECT rel, host, idx, x, sum(x) OVER (PARTITION BY rel, host ORDER BY idx) AS p FROM o),
pts AS (SELECT rel, host, p, min(idx) + 1 AS j FROM p GROUP BY rel, host, p),
need AS (SELECT rel, host, idx, p - x + {k} AS need FROM p),
nx AS (SELECT n.idx, n.rel, n.host, q.j FROM need n ASOF LEFT JOIN pts q ON n.rel = q.rel AND n.host = q.host AND n.need <= q.p),
nr AS (SELECT idx, rel, CASE WHEN count(j) = {hosts} THEN max(j) END AS j FROM nx GROUP BY idx, rel),
nxt AS (SELECT idx, CASE WHEN {"count(j) > 0" if parity else f"count(j) = {len(rels)}"} THEN max(j) END AS j FROM nr GROUP BY idx),
walk AS (SELECT CAST(0 AS BIGINT) AS i UNION ALL SELECT CAST(n.j AS BIGINT) FROM walk w JOIN nxt n ON n.idx = w.i WHERE n.j IS NOT NULL),
cls AS (SELECT w.i FROM walk w JOIN nxt n ON n.idx = w.i WHERE n.j IS NOT NULL),
m AS (SELECT d.key, CAST(coalesce(c.i, 0) AS BIGINT) AS gen FROM dom d ASOF LEFT JOIN cls c ON d.idx >= c.i
  UNION ALL SELECT key, CAST(-1 AS BIGINT) FROM tot GROUP BY key HAVING count(*) < {len(rels)})
"""


def complement_sql(rels: list[tuple[str, str, str]], k: int, domain: str | None = None) -> str:
    """CTEs ending in ``m(key, gen)`` for two owners under 'complement': one recursive step for each key in order.

    ``domain``: SQL of the keys instead of those that all relations have.
    """
    n = len(rels)
    counts = " UNION ALL ".join(f"SELECT {i} AS rel, {key} AS key, CAST({host} % 2 AS INT) AS host FROM {table}" for i, (table, key, host) in enumerate(rels))
    cols = ", ".join(f"count(*) FILTER (rel = {i} AND host = {h}) AS c{i}{h}" for i in range(n) for h in (0, 1))
    state = [f"c{i}{h}" for i in range(n) for h in (0, 1)]
    full = " AND ".join(f"(x.c{i}0 + x.c{i}1 >= {k} AND (x.c{i}0 = 0 OR x.c{i}1 = 0) OR x.c{i}0 >= {k} AND x.c{i}1 >= {k})" for i in range(n))
    total = ", ".join(f"CASE WHEN w.closed THEN 0 ELSE w.{c} END + o.{c} AS {c}" for c in state)
    keys = domain or f"SELECT key FROM raw GROUP BY key HAVING count(DISTINCT rel) = {n}"
    return f"""WITH RECURSIVE raw AS ({counts}),
dom AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS idx FROM ({keys})),
o AS (SELECT d.idx, d.key, {", ".join(f"coalesce({c}, 0) AS {c}" for c in state)} FROM dom d LEFT JOIN (SELECT key, {cols} FROM raw GROUP BY key) USING (key)),
w AS (SELECT CAST(-1 AS BIGINT) AS idx, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS before, {", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in state)}, FALSE AS closed
  UNION ALL SELECT x.*, {full} FROM (SELECT o.idx, CASE WHEN w.closed THEN o.idx ELSE w.first END AS first, CASE WHEN w.closed THEN w.first ELSE w.before END AS before, {total} FROM w JOIN o ON o.idx = w.idx + 1) x),
fin AS (SELECT first, before, closed FROM w ORDER BY idx DESC LIMIT 1),
m AS (SELECT o.key, CAST(CASE WHEN NOT fin.closed AND w.first = fin.first THEN fin.before ELSE w.first END AS BIGINT) AS gen FROM w JOIN o USING (idx) CROSS JOIN fin
  UNION ALL SELECT key, CAST(-1 AS BIGINT) FROM raw WHERE key NOT IN (SELECT key FROM dom) GROUP BY key)
"""


CO = [("customer", "c_custkey", "c_custkey"), ("orders", "o_custkey", "o_orderkey")]
OL = [("orders", "o_orderkey", "o_orderkey"), ("lineitem", "l_orderkey", "l_suppkey")]
REVENUE = "CAST(round(sum(CAST(l_extendedprice AS DECIMAL(15, 2)) * (1 - CAST(l_discount AS DECIMAL(15, 2)))), 2) AS DOUBLE) AS revenue"

Q3 = f"""SELECT l_orderkey, o_orderdate, {REVENUE} FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-22' AND l_shipdate > TIMESTAMP '1995-03-22' GROUP BY l_orderkey, o_orderdate"""
Q5 = f"""SELECT n_name, {REVENUE} FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE r_name = 'AFRICA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY n_name"""
Q10 = f"""SELECT c_custkey, c_name, c_acctbal, n_name, {REVENUE} FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey
WHERE l_returnflag = 'R' AND o_orderdate >= TIMESTAMP '1993-07-01' AND o_orderdate < TIMESTAMP '1995-10-01' GROUP BY c_custkey, c_name, c_acctbal, n_name"""

ORACLE_SQL: dict[str, str] = {
    "scan_project": "SELECT c_custkey, c_name, c_mktsegment FROM customer",
    "scan_one_host": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 1",
    "scan_sql": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND NOT (o_totalprice < 1000 OR o_orderpriority ILIKE '%low')",
    "stats_scan": "SELECT CAST(o_orderkey % 2 AS INT) AS host, o_custkey, count(*) AS n FROM orders GROUP BY ALL",
    "local_branch": "SELECT o_custkey, round(sum(o_totalprice), 2) AS t_sum, count(*) AS t_count FROM orders GROUP BY o_custkey",
    "local_semijoin": "SELECT c_mktsegment, CAST(sum(CAST(o_totalprice AS DECIMAL(15, 2))) AS DOUBLE) AS t_sum, count(*) AS t_count FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment",
    "scan_types": " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name AS name, CASE WHEN column_type = 'VARCHAR' THEN 'text' WHEN column_type LIKE '%INT' OR column_type = 'INTEGER' THEN 'integer' WHEN column_type LIKE 'DECIMAL%' OR column_type IN ('FLOAT', 'DOUBLE') THEN 'double' WHEN column_type LIKE 'TIMESTAMP%' OR column_type = 'DATE' THEN 'timestamp' END AS type FROM (DESCRIBE {t})" for t in ("customer", "orders", "lineitem", "nation")),
    "rows_at": "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place FROM orders) JOIN (SELECT unnest([0, 7, 7, 100, 1499, 1099511627776]) AS place) USING (place)",
    "gen_range_check": """WITH t AS (SELECT 'customer' AS relation, c_custkey AS key, c_custkey % 2 AS host FROM customer UNION ALL SELECT 'orders', o_custkey, o_orderkey % 2 FROM orders),
        r AS (SELECT * FROM (VALUES (1, 4), (1, 12), (20, 40), (50, 50)) v(low, high) CROSS JOIN (SELECT DISTINCT relation FROM t))
        SELECT r.relation, low, high, least(count(*) FILTER (host <> 0), count(*) FILTER (host <> 1)) >= 5 AS ok FROM r LEFT JOIN t ON t.relation = r.relation AND key >= low AND key < high GROUP BY r.relation, low, high""",
    "fdw_union": "SELECT o_orderstatus, count(*) AS n FROM (SELECT * FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT * FROM orders WHERE o_orderkey % 2 = 1) GROUP BY o_orderstatus",
    "cohort_ctas": "SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type LIKE 'p%')",
    "cohort_table": "SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type LIKE 'p%')",
    "sql_multi_join": "SELECT c_mktsegment, o_orderpriority, l_linenumber FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_returnflag = 'R' AND o_orderpriority ILIKE '%high%'",
    "sql_group_by": "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderpriority",
    "random_table_ranges": "SELECT CAST(1000 AS BIGINT) AS n, TRUE AS low_a, TRUE AS high_a, TRUE AS low_b, TRUE AS high_b, TRUE AS spread",
    "sample_members": "SELECT CAST(50 AS BIGINT) AS n, CAST(50 AS BIGINT) AS \"distinct\"",
    "filter_eq": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'",
    "filter_neq": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'",
    "filter_contains": "SELECT o_orderkey, o_orderpriority FROM orders WHERE contains(o_orderpriority, 'HIGH')",
    "filter_chain_and": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND contains(o_orderpriority, 'URGENT')",
    "filter_marks_dummies": "SELECT c_custkey, c_mktsegment <> 'BUILDING' AS is_dummy FROM customer",
    "filter_expression": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND NOT (l_discount * 100 > 5)",
    "join_inner": "SELECT c_custkey, o_orderkey, c_name, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey",
    "join_string_key": "SELECT a.n_name, a.n_nationkey, b.n_regionkey FROM nation a JOIN nation b ON a.n_name = b.n_name",
    "join_left_deep": """SELECT c_custkey, o.o_orderkey AS k1, p.o_orderkey AS k2 FROM customer JOIN orders o ON c_custkey = o.o_custkey JOIN orders p ON c_custkey = p.o_custkey
WHERE o.o_totalprice < 200000 AND p.o_orderstatus = 'F'""",
    "join_semi": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "join_anti": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "join_anti_rich": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "random_join_modes": "SELECT CAST(1 AS BIGINT) AS answers, TRUE AS any",
    "join_generalized_padded": gen_sql(CO, 5) + """, l AS (SELECT gen, count(*) AS a FROM customer JOIN m ON key = c_custkey WHERE gen <> -1 GROUP BY gen),
r AS (SELECT gen, count(*) AS b FROM orders JOIN m ON key = o_custkey WHERE gen <> -1 GROUP BY gen),
x AS (SELECT gen, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN m ON key = c_custkey WHERE gen <> -1 GROUP BY gen)
SELECT l.gen, a * b AS padded, coalesce(n, 0) AS "real" FROM l JOIN r USING (gen) LEFT JOIN x USING (gen)""",
    "join_generalized_revealed": "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey",
    "join_oblivious_count": """SELECT (SELECT count(*) FROM customer) * (SELECT count(*) FROM orders) AS padded,
(SELECT count(*) FROM customer JOIN orders ON c_custkey = o_custkey) AS "real" """,
    "agg_count_empty": "SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_totalprice < 0 GROUP BY o_custkey)) AS groups, (SELECT count(*) FROM orders WHERE o_totalprice < 0) AS count",
    "agg_count": "SELECT o_custkey, count(*) AS count FROM orders GROUP BY o_custkey",
    "agg_sum_count_partial": "SELECT l_orderkey, l_returnflag, sum(l_quantity) AS q_sum, count(*) AS q_count FROM lineitem GROUP BY ALL",
    "agg_avg_final": "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS avg_q FROM lineitem GROUP BY ALL",
    "agg_secure_two_level": "SELECT o_custkey, round(sum(o_totalprice), 2) AS t_sum, count(*) AS t_count FROM orders GROUP BY o_custkey",
    "agg_pad_groups": "SELECT o_custkey, count(*) FILTER (o_totalprice > 300000) AS count, count(*) FILTER (o_totalprice > 300000) = 0 AS is_dummy FROM orders GROUP BY o_custkey",
    "agg_min": "SELECT o_custkey, min(o_totalprice) AS least FROM orders GROUP BY o_custkey",
    "agg_merge_partials": "SELECT l_suppkey, sum(l_quantity) AS q_sum, count(*) AS q_count FROM lineitem GROUP BY l_suppkey",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "union_all": "SELECT c_name, c_nationkey FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier",
    "sort_desc_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "sort_global": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey DESC",
    "dummy_sort_truncate": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY'",
    "truncate_bound": "SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey = 1",
    "repartition_hosts": "SELECT o_custkey, CAST(1 AS BIGINT) AS hosts, count(*) AS n FROM orders GROUP BY o_custkey",
    "gen_counts": "SELECT key, count(DISTINCT rel) AS relations, count(*) AS n FROM (SELECT c_custkey AS key, 0 AS rel FROM customer UNION ALL SELECT o_custkey, 1 FROM orders) GROUP BY key",
    "gen_map_k5": gen_sql(CO, 5) + "SELECT key, gen FROM m",
    "gen_map_orders_k7": gen_sql(OL, 7) + "SELECT key, gen FROM m",
    "gen_map_parity": gen_sql(CO, 7, parity=True) + "SELECT key, gen FROM m",
    "gen_map_scan_counts": gen_sql(CO, 5, where=("c_mktsegment = 'BUILDING'", "o_orderstatus = 'F'")) + "SELECT key, gen FROM m",
    "gen_map_complement": complement_sql(CO, 5) + "SELECT key, gen FROM m",
    "gen_dense_range": complement_sql([("customer", "c_nationkey", "c_custkey")], 20, "SELECT unnest(range(0, (SELECT max(c_nationkey) + 1 FROM customer))) AS key") + "SELECT key, gen FROM m",
    "gen_one_host": gen_sql([("customer", "c_nationkey", "c_custkey")], 50, hosts=1) + "SELECT key, gen FROM m",
    "gen_discard": "SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION SELECT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
    "gen_zip": gen_sql(OL, 5) + "SELECT o_orderkey, o_custkey, gen FROM orders JOIN m ON key = o_orderkey WHERE gen <> -1",
    "gen_class_stats": gen_sql(OL, 5) + "SELECT count(*) AS classes, min(n) AS min_keys, max(n) AS max_keys, avg(n) AS avg_keys FROM (SELECT gen, count(*) AS n FROM m WHERE gen <> -1 GROUP BY gen)",
    "gen_verify": gen_sql(CO, 5) + ", s AS (SELECT rel, gen, host, sum(x) AS x FROM o JOIN dom USING (idx) JOIN m USING (key) WHERE gen <> -1 GROUP BY rel, gen, host), g AS (SELECT rel, gen, min(x) >= 5 AS ok FROM s GROUP BY rel, gen) SELECT CASE rel WHEN 0 THEN 'customer' ELSE 'orders' END AS relation, count(*) AS classes, count(*) FILTER (ok) AS ok FROM g GROUP BY rel",
    "make_oblivious": "SELECT CAST(0 AS BIGINT) AS gen, count(*) AS n FROM customer",
    "comorbidity": "SELECT p_brand, count(*) AS cnt FROM part GROUP BY p_brand ORDER BY cnt DESC, p_brand LIMIT 10",
    "dosage": "SELECT c_custkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND contains(o_orderpriority, 'HIGH') AND o_orderstatus = 'F'",
    "aspirin_profile": """SELECT c_mktsegment, n_name, round(avg(l_quantity), 6) AS avg_q FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON c_custkey = o_custkey
JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY c_mktsegment, n_name""",
    "two_party_aggregate": "SELECT o_custkey, count(*) AS cnt FROM orders GROUP BY o_custkey",
    "event_counts": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
ORACLE_SQL |= {f"tpch_q3_{m}": Q3 for m in ("plain", "kanon", "oblivious", "kanon10", "kanon50")}
ORACLE_SQL |= {f"tpch_q5_{m}": Q5 for m in ("plain", "kanon", "oblivious")}
ORACLE_SQL |= {f"tpch_q10_{m}": Q10 for m in ("plain", "kanon", "oblivious")}
ORACLE_SQL |= {f"left_deep_kanon{k}": ORACLE_SQL["join_left_deep"] for k in (5, 50)}
ORACLE_SQL |= {
    f"padding_k{k}": gen_sql(CO, k) + """, l AS (SELECT gen, count(*) AS a FROM customer JOIN m ON key = c_custkey WHERE gen <> -1 GROUP BY gen),
r AS (SELECT gen, count(*) AS b FROM orders JOIN m ON key = o_custkey WHERE gen <> -1 GROUP BY gen)
SELECT (SELECT count(DISTINCT gen) FROM m WHERE gen <> -1) AS classes, (SELECT count(*) FROM m WHERE gen <> -1) AS keys,
(SELECT coalesce(sum(a * b), 0) FROM l JOIN r USING (gen)) AS padded, (SELECT count(*) FROM customer JOIN orders ON c_custkey = o_custkey) AS "real" """
    for k in (5, 10, 50)
}
