"""Registered queries of the federation engine, one for each operator or workload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources
from .federation import Federation
from .frame import DUMMY, GEN, PrivateFrame
from .functions import contains, eq, neq
from .operators import merge_partials
from .plans.generalize import dense_range_map, greedy_merge_map, range_map, range_reaches

HOSTS = 2
#: Owner of each table's rows.
OWNERS = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "supplier": "s_suppkey", "events": "event_id", "nation": "n_nationkey", "region": "r_regionkey", "part": "p_partkey"}
#: In decimals: sums of doubles depend on their order, and rounding shows it.
REVENUE = "CAST(l_extendedprice AS DECIMAL(15, 2)) * (1 - CAST(l_discount AS DECIMAL(15, 2)))"


def federation(spark: SparkSession, sf_dir: str, *tables: str, hosts: int = HOSTS, **owners: str) -> Federation:
    fed = Federation(spark, hosts)
    for t in tables:
        fed.register(t, sources.parquet(spark, sf_dir, t), owners.get(t, OWNERS[t]))
    return fed


# -- scans, filters, projections ------------------------------------------------
def scan_project(spark, d):
    return federation(spark, d, "customer").scan("customer", ["c_custkey", "c_name", "c_mktsegment"]).reveal()


def scan_one_host(spark, d):
    return federation(spark, d, "orders").scan("orders", ["o_orderkey", "o_custkey"], hosts=[1]).reveal()


def scan_sql(spark, d):
    federation(spark, d, "orders")
    return PrivateFrame(sources.query(spark, "SELECT o_orderkey, o_custkey FROM fed_orders WHERE o_orderstatus = 'F' AND NOT (o_totalprice < 1000 OR o_orderpriority ILIKE '%low')")).reveal()


def stats_scan(spark, d):
    return federation(spark, d, "orders").counts("orders", "o_custkey").select("host", F.col("key").alias("o_custkey"), F.col("n").alias("n"))


def local_branch(spark, d):
    """Groups that one owner can finish are aggregated there; the rest is distributed; both are merged."""
    fed = federation(spark, d, "orders", orders="o_custkey")
    both = [fed.scan("orders", ["o_custkey", "o_totalprice"], hosts=[h]).aggregate(["o_custkey"], {"t": "o_totalprice"}, how="sum_count") for h in (0, 1)]
    out = merge_partials(fed.with_local(both[0], both[1]), keys=["o_custkey"], sums=["t_sum", "t_count"])
    return out.reveal().select("o_custkey", F.round("t_sum", 2).alias("t_sum"), F.col("t_count"))


def local_semijoin(spark, d):
    """Customers whose orders are all at the customer's own owner are joined and pre-aggregated there, the others k-anonymously; the partial sums are merged."""
    fed = federation(spark, d, "customer", "orders")
    mine, theirs = ["c_custkey", "c_mktsegment"], ["o_custkey", "o_totalprice"]
    held = fed.counts("orders", "o_custkey").groupBy("key").agg(F.min("host").alias("lo"), F.max("host").alias("hi"))
    local = PrivateFrame(held.where((F.col("lo") == F.col("hi")) & (F.col("lo") == F.pmod("key", F.lit(HOSTS)))).select(F.col("key").alias("c_custkey")))

    def partial(c, o):
        j = c.join(o, "c_custkey", "o_custkey", [("l", "c_mktsegment"), ("r", "o_totalprice")]).truncate()
        return j.aggregate(["c_mktsegment"], {"t": F.expr("CAST(o_totalprice AS DECIMAL(15, 2))")}, how="sum_count")

    parts = [partial(fed.scan("customer", mine, hosts=[h]).semi_join(local, "c_custkey", "c_custkey"), fed.scan("orders", theirs, hosts=[h])) for h in range(HOSTS)]
    private, _ = fed.generalize({"customer": (fed.scan("customer", mine), "c_custkey"), "orders": (fed.scan("orders", theirs), "o_custkey")}, 5)
    parts.append(partial(private["customer"].anti_join(local, "c_custkey", "c_custkey"), private["orders"]))
    out = merge_partials(*parts, keys=["c_mktsegment"], sums=["t_sum", "t_count"]).reveal()
    return out.select("c_mktsegment", F.col("t_sum").cast("double").alias("t_sum"), "t_count")


def scan_types(spark, d):
    """Columns of the tables with the types that owners exchange."""
    out = None
    for t in ("customer", "orders", "lineitem", "nation"):
        one = sources.exchange_types(sources.parquet(spark, d, t)).select(F.lit(t).alias("table_name"), "name", "type")
        out = one if out is None else out.unionByName(one)
    return out


def fdw_union(spark, d):
    """Owners' schemas as separate slices, united by name."""
    orders = sources.parquet(spark, d, "orders")
    fed = Federation(spark, HOSTS)
    fed.register_slices("orders", [orders.where(F.col("o_orderkey") % HOSTS == h) for h in range(HOSTS)])
    return fed.scan("orders", ["o_orderkey", "o_orderstatus"]).reveal().groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def cohort_ctas(spark, d):
    """A cohort as a view, and the rows of its members."""
    sources.register(spark, d, "events")
    sources.query(spark, "SELECT DISTINCT user_id FROM events WHERE event_type LIKE 'p%'").createOrReplaceTempView("cohort")
    return sources.query(spark, "SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT user_id FROM cohort)")


def cohort_table(spark, d):
    """The cohort written as a table (CREATE TABLE AS in the shared folder), and the rows of its members, by a semijoin."""
    sources.register(spark, d, "events")
    cohort = sources.create_table_as(spark, "cohort_members", "SELECT DISTINCT user_id FROM events WHERE event_type LIKE 'p%'")
    events = PrivateFrame(sources.parquet(spark, d, "events").select("event_id", "user_id", "event_type"))
    return events.semi_join(PrivateFrame(cohort), "user_id", "user_id").reveal()


def sql_multi_join(spark, d):
    """A comma join with its conditions in WHERE, as SQL over the federation's views."""
    fed = federation(spark, d, "customer", "orders", "lineitem")
    sql = "SELECT c_mktsegment, o_orderpriority, l_linenumber FROM fed_customer, fed_orders, fed_lineitem WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_returnflag = 'R' AND o_orderpriority ILIKE '%high%'"
    return fed.scan_sql(sql).reveal()


def sql_group_by(spark, d):
    """Aggregates in the scan's own SQL."""
    fed = federation(spark, d, "orders")
    return fed.scan_sql("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM fed_orders GROUP BY o_orderpriority").reveal()


def random_table_ranges(spark, d):
    """What is certain of a random table: its rows and the ranges of its values."""
    t = sources.random_table(spark, 1000, seed=7, a=10_000, b=100)
    return t.agg(F.count(F.lit(1)).alias("n"), F.min("a").between(1, 10_000).alias("low_a"), F.max("a").between(1, 10_000).alias("high_a"), F.min("b").between(1, 100).alias("low_b"), F.max("b").between(1, 100).alias("high_b"), (F.countDistinct("b") > 50).alias("spread"))


def random_table(spark, d):
    return sources.random_table(spark, 1000, seed=7, a=10_000, b=100)


def filter_eq(spark, d):
    return federation(spark, d, "customer").scan("customer", ["c_custkey", "c_mktsegment"]).filter(eq("c_mktsegment", "BUILDING")).reveal()


def filter_neq(spark, d):
    return federation(spark, d, "customer").scan("customer", ["c_custkey", "c_mktsegment"]).filter(neq("c_mktsegment", "BUILDING")).reveal()


def filter_contains(spark, d):
    return federation(spark, d, "orders").scan("orders", ["o_orderkey", "o_orderpriority"]).filter(contains("o_orderpriority", "HIGH")).reveal()


def filter_chain_and(spark, d):
    f = federation(spark, d, "orders").scan("orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"])
    return f.filter(eq("o_orderstatus", "F")).filter(contains("o_orderpriority", "URGENT")).reveal()


def filter_marks_dummies(spark, d):
    f = federation(spark, d, "customer").scan("customer", ["c_custkey", "c_mktsegment"]).filter(eq("c_mktsegment", "BUILDING"))
    return f.df.select("c_custkey", F.col(DUMMY).alias("is_dummy"))


def filter_expression(spark, d):
    f = federation(spark, d, "lineitem").scan("lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_discount"])
    return f.filter(F.col("l_quantity").between(10, 20) & ~(F.col("l_discount") * 100 > 5)).project("l_orderkey", "l_linenumber").reveal()


# -- joins ------------------------------------------------------------------------
def _customer_orders(spark, d):
    fed = federation(spark, d, "customer", "orders")
    return fed, fed.scan("customer", ["c_custkey", "c_name", "c_mktsegment"]), fed.scan("orders", ["o_orderkey", "o_custkey", "o_totalprice"])


CO = [("l", "c_custkey"), ("r", "o_orderkey")]


def join_inner(spark, d):
    _, c, o = _customer_orders(spark, d)
    return c.join(o, "c_custkey", "o_custkey", [*CO, ("l", "c_name"), ("r", "o_totalprice")]).reveal()


def join_string_key(spark, d):
    fed = federation(spark, d, "nation", "region")
    n, m = fed.scan("nation", ["n_name", "n_nationkey"]), fed.scan("nation", ["n_name", "n_regionkey"])
    return n.join(m, "n_name", "n_name", [("l", "n_name"), ("l", "n_nationkey"), ("r", "n_regionkey")]).reveal()


def join_left_deep(spark, d):
    """A chain on one shared key."""
    fed = federation(spark, d, "customer", "orders")
    c = fed.scan("customer", ["c_custkey"])
    o = fed.scan("orders", ["o_orderkey", "o_custkey"], where="o_totalprice < 200000")
    p = fed.scan("orders", ["o_orderkey", "o_custkey"], where="o_orderstatus = 'F'")
    first = c.join(o, "c_custkey", "o_custkey", [("l", "c_custkey"), ("r", "o_orderkey", "k1")])
    return first.join(p, "c_custkey", "o_custkey", [("l", "c_custkey"), ("l", "k1"), ("r", "o_orderkey", "k2")]).reveal()


def join_semi(spark, d):
    _, c, o = _customer_orders(spark, d)
    return c.semi_join(o.filter(F.col("o_totalprice") > 200000), "c_custkey", "o_custkey").reveal()


def join_anti(spark, d):
    _, c, o = _customer_orders(spark, d)
    return c.anti_join(o, "c_custkey", "o_custkey").reveal()


def _kanon_join(spark, d, k=5):
    fed, c, o = _customer_orders(spark, d)
    g, m = fed.generalize({"customer": (c, "c_custkey"), "orders": (o, "o_custkey")}, k)
    return g["customer"].join(g["orders"], "c_custkey", "o_custkey", CO), m


def join_generalized_padded(spark, d):
    """Rows with padding and real rows of each class."""
    j, _ = _kanon_join(spark, d)
    return j.df.groupBy(F.col(GEN + "c_custkey").alias("gen")).agg(F.count(F.lit(1)).alias("padded"), F.sum(F.when(~F.col(DUMMY), 1).otherwise(0)).alias("real"))


def join_generalized_revealed(spark, d):
    return _kanon_join(spark, d)[0].truncate().reveal()


def join_oblivious_count(spark, d):
    """The cross product of the whole tables: its size, as a product of counts, and its real rows, by the equi-join."""
    fed = federation(spark, d, "customer", "orders")
    c = fed.scan("customer", ["c_custkey"]).make_oblivious("c_custkey")
    o = fed.scan("orders", ["o_orderkey", "o_custkey"]).make_oblivious("o_custkey")
    a, b = (f.df.agg(F.count(F.lit(1)).alias(n)) for f, n in ((c, "a"), (o, "b")))
    real = c.join(o, "c_custkey", "o_custkey", CO).truncate().df.agg(F.count(F.lit(1)).alias("real"))
    return a.crossJoin(b).crossJoin(real).select((F.col("a") * F.col("b")).alias("padded"), "real")


def join_anti_rich(spark, d):
    """Customers without any order of more than 200000."""
    _, c, o = _customer_orders(spark, d)
    return c.anti_join(o.filter(F.col("o_totalprice") > 200000), "c_custkey", "o_custkey").reveal()


def left_deep(spark, d, k):
    """The chain of ``join_left_deep`` with classes of k."""
    fed = federation(spark, d, "customer", "orders")
    scans = {"customer": (fed.scan("customer", ["c_custkey"]), "c_custkey"), "orders": (fed.scan("orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"]), "o_custkey")}
    private, _ = fed.generalize(scans, k)
    c, o = private["customer"], private["orders"]
    first = c.join(o.filter(F.col("o_totalprice") < 200000), "c_custkey", "o_custkey", [("l", "c_custkey"), ("r", "o_orderkey", "k1")]).truncate()
    return first.join(o.filter(eq("o_orderstatus", "F")), "c_custkey", "o_custkey", [("l", "c_custkey"), ("l", "k1"), ("r", "o_orderkey", "k2")]).truncate().reveal()


def left_deep_kanon5(spark, d):
    return left_deep(spark, d, 5)


def left_deep_kanon50(spark, d):
    return left_deep(spark, d, 50)


def padding(spark, d, k):
    """Classes, distinct keys, and rows of customer join orders with and without padding; the padded join is counted, not built."""
    fed = federation(spark, d, "customer", "orders")
    scans = {"customer": (fed.scan("customer", ["c_custkey"]), "c_custkey"), "orders": (fed.scan("orders", ["o_orderkey", "o_custkey"]), "o_custkey")}
    private, classes = fed.generalize(scans, k)
    c, o = private["customer"], private["orders"]
    keys = classes.df.where("gen <> -1").agg(F.countDistinct("gen").alias("classes"), F.count(F.lit(1)).alias("keys"))
    real = c.join(o, "c_custkey", "o_custkey", CO).truncate().df.agg(F.count(F.lit(1)).alias("real"))
    return keys.crossJoin(c.padded_join_size(o, "c_custkey", "o_custkey")).crossJoin(real)


def padding_k5(spark, d):
    return padding(spark, d, 5)


def padding_k10(spark, d):
    return padding(spark, d, 10)


def padding_k50(spark, d):
    return padding(spark, d, 50)


def random_join_modes(spark, d):
    """Two random tables joined plain, generalized with several k, and obliviously: the answers agree."""
    fed = Federation(spark, HOSTS)
    for name, rows, seed in (("ra", 2000, 1), ("rb", 1500, 11)):
        fed.register(name, sources.random_table(spark, rows, seed=seed, a=10_000, b=512), "a")
    scans = {"ra": (fed.scan("ra"), "b"), "rb": (fed.scan("rb"), "b")}
    out = None
    for k in (0, 5, 25, -1):
        if k > 0:
            sides = list(fed.generalize(scans, k)[0].values())
        else:
            sides = [f.make_oblivious("b") if k else f for f, _ in scans.values()]
        n = sides[0].join(sides[1], "b", "b", [("l", "a"), ("r", "a", "a2"), ("l", "b")]).truncate().df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a") * 3 + F.col("a2")).alias("s"))
        out = n if out is None else out.unionByName(n)
    # Keys that one table lacks have no class, and no partner either.
    return out.agg(F.countDistinct("n", "s").alias("answers"), (F.min("n") > 0).alias("any"))


# -- aggregation -------------------------------------------------------------------
def agg_count_empty(spark, d):
    """COUNT over no rows has no groups, and one row of 0 without keys."""
    none = federation(spark, d, "orders").scan("orders", ["o_custkey"], where="o_totalprice < 0")
    groups = none.count_by("o_custkey").reveal().agg(F.count(F.lit(1)).alias("groups"))
    return groups.crossJoin(none.count_by(pad_groups=True).df.select("count"))


def agg_count(spark, d):
    return federation(spark, d, "orders").scan("orders", ["o_custkey"]).count_by("o_custkey").reveal()


def agg_sum_count_partial(spark, d):
    out = federation(spark, d, "lineitem").scan("lineitem", ["l_orderkey", "l_returnflag", "l_quantity"]).aggregate(["l_orderkey", "l_returnflag"], {"q": "l_quantity"}, how="sum_count")
    return out.reveal()


def agg_avg_final(spark, d):
    out = federation(spark, d, "lineitem").scan("lineitem", ["l_returnflag", "l_linestatus", "l_quantity"]).aggregate(["l_returnflag", "l_linestatus"], {"avg_q": "l_quantity"}, how="avg")
    return out.reveal().select("l_returnflag", "l_linestatus", F.round("avg_q", 6).alias("avg_q"))


def agg_secure_two_level(spark, d):
    fed, _, o = _customer_orders(spark, d)
    m = fed.gen_map({"orders": "o_custkey"}, 5)
    out = o.generalize("o_custkey", m.df).aggregate(["o_custkey"], {"t": "o_totalprice"}, how="sum_count", kanon_col="o_custkey")
    return out.reveal().select("o_custkey", F.round("t_sum", 2).alias("t_sum"), "t_count")


def agg_pad_groups(spark, d):
    """Groups of dummies alone stay, with zero."""
    o = federation(spark, d, "orders").scan("orders", ["o_custkey", "o_totalprice"]).filter(F.col("o_totalprice") > 300000)
    out = o.count_by("o_custkey", pad_groups=True).df
    return out.select("o_custkey", "count", F.col(DUMMY).alias("is_dummy"))


def agg_min(spark, d):
    return federation(spark, d, "orders").scan("orders", ["o_custkey", "o_totalprice"]).aggregate(["o_custkey"], {"least": "o_totalprice"}, how="min").reveal()


def agg_merge_partials(spark, d):
    fed = federation(spark, d, "lineitem")
    parts = [fed.scan("lineitem", ["l_suppkey", "l_quantity"], hosts=[h]).aggregate(["l_suppkey"], {"q": "l_quantity"}, how="sum_count") for h in range(HOSTS)]
    return merge_partials(*parts, keys=["l_suppkey"], sums=["q_sum", "q_count"]).reveal()


def distinct(spark, d):
    return federation(spark, d, "orders").scan("orders", ["o_orderstatus", "o_orderpriority"]).project("o_orderstatus", "o_orderpriority").distinct().reveal()


# -- union, sort, limit ------------------------------------------------------------
def union_all(spark, d):
    fed = federation(spark, d, "customer", "supplier")
    return fed.scan("customer", ["c_name", "c_nationkey"]).union(fed.scan("supplier", ["s_name", "s_nationkey"])).reveal()


def sort_desc_topk(spark, d):
    return federation(spark, d, "orders").scan("orders", ["o_orderkey", "o_totalprice"]).top(25, F.desc("o_totalprice"), F.asc("o_orderkey")).reveal()


def sort_global(spark, d):
    return federation(spark, d, "customer").scan("customer", ["c_custkey", "c_acctbal"]).sort("c_acctbal", "c_custkey", ascending=False).reveal()


def dummy_sort_truncate(spark, d):
    c = federation(spark, d, "customer").scan("customer", ["c_custkey", "c_mktsegment"]).filter(eq("c_mktsegment", "MACHINERY"))
    return c.dummy_sort().truncate().reveal()


def truncate_bound(spark, d):
    """A cardinality bound that all real rows fit in."""
    c = federation(spark, d, "nation").scan("nation", ["n_nationkey", "n_regionkey"]).filter(eq("n_regionkey", 1))
    return c.truncate_to(10).reveal()


def sample_n(spark, d):
    return federation(spark, d, "customer").scan("customer", ["c_custkey"]).sample(50, seed=3).reveal()


def rows_at(spark, d):
    """Rows by their places in an order; one place twice, one beyond the end."""
    o = federation(spark, d, "orders").scan("orders", ["o_orderkey", "o_totalprice"])
    return o.at([0, 7, 7, 100, 1499, 1 << 40], "o_totalprice", "o_orderkey").reveal()


def sample_members(spark, d):
    """What is certain of a sample: its size, that it has no row twice, and that all are customers."""
    fed = federation(spark, d, "customer")
    got = fed.scan("customer", ["c_custkey"]).sample(50, seed=3)
    known = got.semi_join(fed.scan("customer", ["c_custkey"], where="c_custkey IS NOT NULL"), "c_custkey", "c_custkey").reveal()
    return known.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_custkey").alias("distinct"))


# -- distribution ------------------------------------------------------------------
def repartition_hosts(spark, d):
    """Rows and owners of each key after repartitioning: one owner each."""
    o = federation(spark, d, "orders").scan("orders", ["o_orderkey", "o_custkey"]).repartition(4, "o_custkey", shuffle_first=True)
    return o.df.groupBy("o_custkey").agg(F.countDistinct("__host").alias("hosts"), F.count(F.lit(1)).alias("n"))


# -- generalization ----------------------------------------------------------------
def _map(spark, d, k=5, **how):
    return federation(spark, d, "customer", "orders").gen_map({"customer": "c_custkey", "orders": "o_custkey"}, k, **how)


def gen_counts(spark, d):
    """Relations and tuples of each key."""
    fed = federation(spark, d, "customer", "orders")
    both = fed.counts("customer", "c_custkey").withColumn("rel", F.lit(0)).unionByName(fed.counts("orders", "o_custkey").withColumn("rel", F.lit(1)))
    return both.groupBy("key").agg(F.countDistinct("rel").alias("relations"), F.sum("n").alias("n"))


def gen_map_k5(spark, d):
    return _map(spark, d).df


def _order_map(spark, d, k):
    return federation(spark, d, "orders", "lineitem", lineitem="l_suppkey").gen_map({"orders": "o_orderkey", "lineitem": "l_orderkey"}, k)


def gen_map_orders_k7(spark, d):
    return _order_map(spark, d, 7).df


def gen_map_parity(spark, d):
    return _map(spark, d, 7, parity=True).df


def gen_map_complement(spark, d):
    return _map(spark, d, 5, criterion="complement").df


def gen_map_scan_counts(spark, d):
    """Classes from the filtered scans instead of the base tables."""
    fed = federation(spark, d, "customer", "orders")
    c, o = fed.scan("customer", where="c_mktsegment = 'BUILDING'"), fed.scan("orders", where="o_orderstatus = 'F'")
    return fed.generalize({"customer": (c, "c_custkey"), "orders": (o, "o_custkey")}, 5, counts_from="scan")[1].df


def gen_discard(spark, d):
    return _order_map(spark, d, 5).df.where("gen = -1").select("key")


def gen_zip(spark, d):
    fed = federation(spark, d, "orders", "lineitem", lineitem="l_suppkey")
    m = fed.gen_map({"orders": "o_orderkey", "lineitem": "l_orderkey"}, 5)
    o = fed.scan("orders", ["o_orderkey", "o_custkey"]).generalize("o_orderkey", m.df)
    return o.df.select("o_orderkey", "o_custkey", F.col(GEN + "o_orderkey").alias("gen"))


def gen_class_stats(spark, d):
    return _order_map(spark, d, 5).class_stats()


def gen_verify(spark, d):
    """Classes of each relation and how many of them meet the criterion."""
    v = _map(spark, d).verify()
    return v.groupBy("relation").agg(F.count(F.lit(1)).alias("classes"), F.sum(F.col("ok").cast("int")).alias("ok"))


def gen_range_check(spark, d):
    """Does a whole range of keys reach k as one class?"""
    fed = federation(spark, d, "customer", "orders")
    counts = {"customer": fed.counts("customer", "c_custkey"), "orders": fed.counts("orders", "o_custkey")}
    out = None
    for low, high in ((1, 4), (1, 12), (20, 40), (50, 50)):
        one = range_reaches(counts, HOSTS, 5, low, high).select("relation", F.lit(low).alias("low"), F.lit(high).alias("high"), "ok")
        out = one if out is None else out.unionByName(one)
    return out


def gen_dense_range(spark, d):
    return dense_range_map({"nation": federation(spark, d, "customer").counts("customer", "c_nationkey")}, HOSTS, 20)


def gen_greedy_merge(spark, d):
    return greedy_merge_map(federation(spark, d, "customer").counts("customer", "c_nationkey"), HOSTS, 40)


def gen_one_host(spark, d):
    return range_map({"customer": _one_owner(spark, d)}, 1, 50).df


def _one_owner(spark, d):
    return federation(spark, d, "customer", hosts=1).counts("customer", "c_nationkey")


def make_oblivious(spark, d):
    c = federation(spark, d, "customer").scan("customer", ["c_custkey"]).make_oblivious("c_custkey")
    return c.df.groupBy(F.col(GEN + "c_custkey").alias("gen")).agg(F.count(F.lit(1)).alias("n"))


# -- workloads ---------------------------------------------------------------------
def _mode(fed, frames: dict, mode: str, k: int, classes=None):
    """Classes for one join's two sides: by value, k-anonymous, or one for all."""
    if mode == "kanon":
        return list(fed.generalize(frames, k, classes=classes)[0].values())
    if mode == "oblivious":
        return [f.make_oblivious(c) for f, c in frames.values()]
    return [f for f, _ in frames.values()]


def _order_maps(fed, mode: str, k: int):
    """The class maps of the joins on customers and on orders, in the k-anonymous mode."""
    if mode != "kanon":
        return None, None
    return fed.gen_maps([{"customer": "c_custkey", "orders": "o_custkey"}, {"orders": "o_orderkey", "lineitem": "l_orderkey"}], k)


def tpch_q3(spark, d, mode="plain", k=5):
    fed = federation(spark, d, "customer", "orders", "lineitem")
    c = fed.scan("customer", ["c_custkey"], where="c_mktsegment = 'BUILDING'")
    o = fed.scan("orders", ["o_orderkey", "o_custkey", "o_orderdate"], where="o_orderdate < TIMESTAMP '1995-03-22'")
    li = fed.scan("lineitem", ["l_orderkey", "l_extendedprice", "l_discount"], where="l_shipdate > TIMESTAMP '1995-03-22'")
    by_customer, by_order = _order_maps(fed, mode, k)
    c, o = _mode(fed, {"customer": (c, "c_custkey"), "orders": (o, "o_custkey")}, mode, k, by_customer)
    co = c.join(o, "c_custkey", "o_custkey", [("r", "o_orderkey"), ("r", "o_custkey"), ("r", "o_orderdate")]).truncate()
    co, li = _mode(fed, {"orders": (co, "o_orderkey"), "lineitem": (li, "l_orderkey")}, mode, k, by_order)
    j = co.join(li, "o_orderkey", "l_orderkey", [("r", "l_orderkey"), ("l", "o_orderdate"), ("l", "o_custkey"), ("r", "l_extendedprice"), ("r", "l_discount")]).truncate()
    out = j.aggregate(["l_orderkey", "o_orderdate"], {"revenue": F.expr(REVENUE)}, kanon_col="o_custkey" if mode == "kanon" else None)
    return out.reveal().select("l_orderkey", "o_orderdate", F.round("revenue", 2).cast("double").alias("revenue"))


def tpch_q5(spark, d, mode="plain", k=5):
    fed = federation(spark, d, "customer", "orders", "lineitem", "supplier", "nation", "region")
    r = fed.scan("region", ["r_regionkey"], where="r_name = 'AFRICA'")
    n = fed.scan("nation", ["n_nationkey", "n_name", "n_regionkey"])
    s = fed.scan("supplier", ["s_suppkey", "s_nationkey"])
    c = fed.scan("customer", ["c_custkey"])
    o = fed.scan("orders", ["o_orderkey", "o_custkey"], where="o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
    li = fed.scan("lineitem", ["l_orderkey", "l_suppkey", "l_extendedprice", "l_discount"])
    rn = r.join(n, "r_regionkey", "n_regionkey", [("r", "n_nationkey"), ("r", "n_name")])
    sn = rn.join(s, "n_nationkey", "s_nationkey", [("r", "s_suppkey"), ("l", "n_name")])
    by_customer, by_order = _order_maps(fed, mode, k)
    c, o = _mode(fed, {"customer": (c, "c_custkey"), "orders": (o, "o_custkey")}, mode, k, by_customer)
    co = c.join(o, "c_custkey", "o_custkey", [("r", "o_orderkey")]).truncate()
    co, li = _mode(fed, {"orders": (co, "o_orderkey"), "lineitem": (li, "l_orderkey")}, mode, k, by_order)
    col = co.join(li, "o_orderkey", "l_orderkey", [("r", "l_suppkey"), ("r", "l_extendedprice"), ("r", "l_discount")]).truncate()
    j = sn.join(col, "s_suppkey", "l_suppkey", [("l", "n_name"), ("r", "l_extendedprice"), ("r", "l_discount")]).truncate()
    return j.aggregate(["n_name"], {"revenue": F.expr(REVENUE)}).reveal().select("n_name", F.round("revenue", 2).cast("double").alias("revenue"))


def tpch_q10(spark, d, mode="plain", k=5):
    fed = federation(spark, d, "customer", "orders", "lineitem", "nation")
    c = fed.scan("customer", ["c_custkey", "c_name", "c_acctbal", "c_nationkey"])
    o = fed.scan("orders", ["o_orderkey", "o_custkey"], where="o_orderdate >= TIMESTAMP '1993-07-01' AND o_orderdate < TIMESTAMP '1995-10-01'")
    li = fed.scan("lineitem", ["l_orderkey", "l_extendedprice", "l_discount"], where="l_returnflag = 'R'")
    n = fed.scan("nation", ["n_nationkey", "n_name"])
    by_customer, by_order = _order_maps(fed, mode, k)
    c, o = _mode(fed, {"customer": (c, "c_custkey"), "orders": (o, "o_custkey")}, mode, k, by_customer)
    keep = [("l", "c_custkey"), ("l", "c_name"), ("l", "c_acctbal"), ("l", "c_nationkey")]
    co = c.join(o, "c_custkey", "o_custkey", [*keep, ("r", "o_orderkey")]).truncate()
    co, li = _mode(fed, {"orders": (co, "o_orderkey"), "lineitem": (li, "l_orderkey")}, mode, k, by_order)
    j = co.join(li, "o_orderkey", "l_orderkey", [*keep, ("r", "l_extendedprice"), ("r", "l_discount")]).truncate()
    j = n.join(j, "n_nationkey", "c_nationkey", [("r", "c_custkey"), ("r", "c_name"), ("r", "c_acctbal"), ("l", "n_name"), ("r", "l_extendedprice"), ("r", "l_discount")]).truncate()
    out = j.aggregate(["c_custkey", "c_name", "c_acctbal", "n_name"], {"revenue": F.expr(REVENUE)}, kanon_col="c_custkey" if mode == "kanon" else None)
    return out.reveal().withColumn("revenue", F.round("revenue", 2).cast("double"))


def comorbidity(spark, d):
    """The ten most frequent brands, generalized by brand with k=5."""
    fed = federation(spark, d, "part")
    p, m = fed.generalize({"part": (fed.scan("part", ["p_brand"]), "p_brand")}, 5)
    out = p["part"].aggregate(["p_brand"], {"cnt": F.lit(1)}, how="count", kanon_col="p_brand")
    return out.top(10, F.desc("cnt"), "p_brand").reveal()


def dosage(spark, d):
    """Customers of a segment with orders of a priority."""
    fed = federation(spark, d, "customer", "orders")
    c = fed.scan("customer", ["c_custkey", "c_mktsegment"])
    o = fed.scan("orders", ["o_custkey", "o_orderpriority", "o_orderstatus"])
    g, _ = fed.generalize({"customer": (c, "c_custkey"), "orders": (o, "o_custkey")}, 5)
    c, o = g["customer"].filter(eq("c_mktsegment", "BUILDING")), g["orders"].filter(contains("o_orderpriority", "HIGH")).filter(eq("o_orderstatus", "F"))
    return c.join(o, "c_custkey", "o_custkey", [("l", "c_custkey")]).truncate().reveal()


def aspirin_profile(spark, d):
    """A mean over four tables, by two attributes."""
    fed = federation(spark, d, "customer", "nation", "orders", "lineitem")
    c = fed.scan("customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    o = fed.scan("orders", ["o_orderkey", "o_custkey"])
    g, _ = fed.generalize({"customer": (c, "c_custkey"), "orders": (o, "o_custkey")}, 5)
    co = g["customer"].join(g["orders"], "c_custkey", "o_custkey", [("l", "c_mktsegment"), ("l", "c_nationkey"), ("r", "o_orderkey")]).truncate()
    li = fed.scan("lineitem", ["l_orderkey", "l_quantity"], where="l_returnflag = 'R'")
    j = co.join(li, "o_orderkey", "l_orderkey", [("l", "c_mktsegment"), ("l", "c_nationkey"), ("r", "l_quantity")]).truncate()
    j = fed.scan("nation", ["n_nationkey", "n_name"]).join(j, "n_nationkey", "c_nationkey", [("r", "c_mktsegment"), ("l", "n_name"), ("r", "l_quantity")]).truncate()
    out = j.aggregate(["c_mktsegment", "n_name"], {"avg_q": "l_quantity"}, how="avg")
    return out.reveal().withColumn("avg_q", F.round("avg_q", 6))


def two_party_aggregate(spark, d):
    """Counts over two owners' shares of a table, repartitioned by the key."""
    o = federation(spark, d, "orders").scan("orders", ["o_custkey"]).repartition(HOSTS, "o_custkey")
    return o.count_by("o_custkey", alias="cnt").reveal()


def event_counts(spark, d):
    from .streaming import event_counts as counts

    return counts(sources.parquet(spark, d, "events")).select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def _named(*fs) -> dict:
    return {f.__name__: f for f in fs}


QUERIES: dict = _named(
    scan_project, scan_one_host, scan_sql, stats_scan, local_branch, local_semijoin, scan_types, fdw_union, cohort_ctas, cohort_table, sql_multi_join, sql_group_by, random_table, random_table_ranges,
    filter_eq, filter_neq, filter_contains, filter_chain_and, filter_marks_dummies, filter_expression,
    join_inner, join_string_key, join_left_deep, left_deep_kanon5, left_deep_kanon50, join_semi, join_anti, join_generalized_padded, join_generalized_revealed, join_oblivious_count, join_anti_rich, padding_k5, padding_k10, padding_k50, random_join_modes,
    agg_count, agg_count_empty, agg_sum_count_partial, agg_avg_final, agg_secure_two_level, agg_pad_groups, agg_min, agg_merge_partials, distinct,
    union_all, sort_desc_topk, sort_global, dummy_sort_truncate, truncate_bound, sample_n, rows_at, sample_members, repartition_hosts,
    gen_counts, gen_map_k5, gen_map_orders_k7, gen_map_parity, gen_map_complement, gen_map_scan_counts, gen_discard, gen_zip, gen_class_stats, gen_verify, gen_range_check, gen_dense_range, gen_greedy_merge, gen_one_host, make_oblivious,
    comorbidity, dosage, aspirin_profile, two_party_aggregate, event_counts,
)


def _tpch(f, mode: str, k: int = 5):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(spark, sf_dir, mode, k)

    return run


for _f in (tpch_q3, tpch_q5, tpch_q10):
    for _m in ("plain", "kanon", "oblivious"):
        QUERIES[f"{_f.__name__}_{_m}"] = _tpch(_f, _m)
for _k in (10, 50):
    QUERIES[f"tpch_q3_kanon{_k}"] = _tpch(tpch_q3, "kanon", _k)
