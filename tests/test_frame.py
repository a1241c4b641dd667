"""Literal operator fixtures and properties of the padded algebra."""

import random
import re

import pytest
from anonframe.federation import Federation
from anonframe.frame import DUMMY, GEN, PrivateFrame
from anonframe.functions import contains, eq, neq
from anonframe.plans import generalize as g
from anonframe.sources import check_types, exchange_types
from pyspark.sql import functions as F


def frame(spark, rows, schema):
    return PrivateFrame(spark.createDataFrame(rows, schema))


def dummies(f):
    return [tuple(r) for r in f.df.select(*f.columns, DUMMY).collect()]


def real(f):
    return sorted(tuple(r) for r in f.reveal().collect())


def test_filters(spark):
    f = frame(spark, [(1, 2), (1, 3), (2, 3)], "a int, b int")
    assert dummies(f.filter(eq("a", 1))) == [(1, 2, False), (1, 3, False), (2, 3, True)]
    assert real(f.filter(eq("a", 2)).filter(eq("b", 3))) == [(2, 3)]
    s = frame(spark, [(1, "aaa"), (2, "b"), (3, None), (4, "100%")], "a int, b string")
    assert [r[2] for r in dummies(s.filter(contains("b", "a")))] == [False, True, True, True]
    assert real(s.filter(contains("b", "%"))) == [(4, "100%")]
    assert real(s.filter(neq("b", "b"))) == [(1, "aaa"), (4, "100%")]


def test_joins(spark):
    j = frame(spark, [(1, 7), (7, 8), (3, 4), (7, 9)], "a int, b int")
    assert real(j.join(j, "b", "a", [("l", "a"), ("r", "b")])) == [(1, 8), (1, 9)]
    t = frame(spark, [(1, 2), (1, 3), (1, 4)], "a int, b int")
    four = [("l", "a", "a1"), ("l", "b", "b1"), ("r", "a", "a2"), ("r", "b", "b2")]
    assert len(real(t.join(t, "a", "a", four))) == 9
    s = frame(spark, [(1, "2"), (1, "3"), (1, "4")], "a int, b string")
    assert len(real(s.join(s, "b", "b", four))) == 3
    o = t.make_oblivious("b")
    padded = o.join(o, "b", "b", four)
    assert padded.padded_count() == 9 and len(real(padded)) == 3 and len(real(padded.truncate())) == 3
    with pytest.raises(ValueError, match="repeat"):
        t.join(t, "a", "a")
    n = frame(spark, [(None, 1), (2, 2)], "a int, b int")
    assert real(n.join(n, "a", "a", four)) == [(2, 2, 2, 2)]
    both = t.filter(eq("b", 2)).join(t, "b", "b", [("l", "a"), ("r", "b")])
    assert real(both) == [(1, 2)]


def _optimized(frame):
    return frame.df._jdf.queryExecution().optimizedPlan().toString()


def test_padding_is_folded_into_the_join(spark, tmp_path):
    t = spark.range(50).select(F.col("id").alias("a"))
    t.write.parquet(str(tmp_path / "t"))  # its columns come back nullable
    for df in (t, spark.read.parquet(str(tmp_path / "t"))):
        o = PrivateFrame(df).make_oblivious("a")
        assert re.search(r"Join Inner, .*a#\d+L <?=>? a#\d+L", _optimized(o.join(o, "a", "a", [("l", "a", "x")]).truncate()))  # no cross product is left
        g = PrivateFrame(df.withColumn("__gen_a", F.col("a") % 3))
        assert "(a#" in re.search(r"Join Inner, .*", _optimized(g.join(g, "a", "a", [("l", "a", "x")]).truncate()))[0]


def test_null_keys_pair_with_nothing(spark):
    f = frame(spark, [(1,), (None,), (2,)], "a int").make_oblivious("a")
    j = f.join(f, "a", "a", [("l", "a", "x"), ("r", "a", "y")])
    assert j.df.count() == 9 and real(j) == [(1, 1), (2, 2)]


def test_workloads_never_multiply(spark, sf):
    from anonframe import catalog

    for name in ("tpch_q3_oblivious", "tpch_q3_kanon", "tpch_q10_kanon"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_partition_is_host(spark):
    f = frame(spark, [(i,) for i in range(200)], "a int").repartition(5, "a")
    rows = f.df.withColumn("p", F.spark_partition_id()).select("p", "__host").distinct().collect()
    assert f.df.rdd.getNumPartitions() == 5 and {(r[0], r[1]) for r in rows} == {(h, h) for h in range(5)}


def test_aggregates(spark):
    f = frame(spark, [(1, 7), (2, 7), (3, 4)], "a int, b int")
    assert real(f.count_by("b")) == [(4, 1), (7, 2)]
    assert real(f.aggregate(["b"], {"a": "a"}, how="sum_count")) == [(4, 3, 1), (7, 3, 2)]
    m = frame(spark, [(1, 7, 8), (1, 7, 9), (3, 4, 5)], "a int, b int, c int")
    assert real(m.aggregate(["b", "a"], {"c": "c"}, how="sum_count")) == [(4, 3, 5, 1), (7, 1, 17, 2)]
    k = frame(spark, [(10, 0, 1), (0, 1, 2)], "k1 int, k2 int, v int")
    assert real(k.aggregate(["k1", "k2"], {"s": "v"})) == [(0, 1, 2), (10, 0, 1)]
    d = f.filter(eq("b", 4))
    assert real(d.count_by("b")) == [(4, 1)]
    assert sorted(dummies(d.count_by("b", pad_groups=True))) == [(4, 1, False), (7, 0, True)]
    assert real(d.aggregate(["b"], {"m": "a"}, how="min")) == [(4, 3)]
    assert real(f.aggregate(["b"], {"m": "a"}, how="avg", kanon_col="b")) == [(4, 3.0), (7, 1.5)]
    assert frame(spark, [], "a int, b int").count_by("b").df.count() == 0
    with pytest.raises(ValueError):
        f.aggregate(["b"], {"m": "a"}, how="median")


def test_sort_truncate_union(spark):
    f = frame(spark, [(7, 6), (8, 3), (9, 1), (4, 2)], "a int, b int")
    assert [r[1] for r in f.filter(neq("a", 4)).dummy_sort().truncate().sort("b").reveal().collect()] == [1, 3, 6]
    assert f.filter(neq("a", 4)).truncate_to(3).df.where(DUMMY).count() == 0
    rows = frame(spark, [(i, i % 2) for i in range(500)], "a int, b int").filter(eq("b", 0))
    assert rows.dummy_sort().truncate().df.count() == 250
    assert rows.union(rows).padded_count() == 1000 and len(real(rows.union(rows))) == 500
    with pytest.raises(ValueError):
        f.union(f.project("a"))
    assert f.sample(2, seed=1).df.count() == 2


def test_repartition_keeps_keys_together(spark):
    f = frame(spark, [(1, "2", 3), (1, "2", 4), (1, "2", 5), (1, "4", 5), (1, "4", 6)], "a int, b string, c int").repartition(4, "a", "b", shuffle_first=True)
    assert f.df.groupBy("a", "b").agg(F.countDistinct("__host").alias("n")).where("n > 1").isEmpty()
    assert f.df.select("__host").where("__host NOT BETWEEN 0 AND 3").isEmpty()


def test_strict_types(spark):
    check_types(spark.createDataFrame([(1, "a", 1.0)], "a int, b string, c double"))
    with pytest.raises(ValueError, match="boolean"):
        check_types(spark.createDataFrame([(True,)], "a boolean"))


def counts(spark, triples):
    return spark.createDataFrame(triples, "key long, host int, n long")


GOLDEN = [
    ([[(1, 0, 3), (1, 1, 2), (2, 0, 1), (2, 1, 1), (3, 0, 4), (4, 1, 4), (5, 0, 1)]], 3, {1: 0, 2: 0, 3: 2, 4: 3, 5: 3}, {1: 0, 2: 0, 3: 2, 4: 3, 5: 3}),
    ([[(1, 0, 2), (1, 1, 2), (2, 0, 2), (2, 1, 2), (9, 0, 5)], [(1, 0, 2), (1, 1, 2), (2, 1, 3), (2, 0, 3), (7, 1, 1)]], 2, {1: 0, 2: 1, 7: -1, 9: -1}, {1: 0, 2: 1, 7: -1, 9: -1}),
    ([[(1, 0, 5), (1, 1, 5), (2, 0, 1), (2, 1, 1)], [(1, 0, 5), (1, 1, 5), (2, 0, 9), (2, 1, 9)]], 5, {1: 0, 2: 0}, {1: 0, 2: 1}),
]


@pytest.mark.parametrize("rels,k,strict,parity", GOLDEN)
def test_golden_maps(spark, rels, k, strict, parity):
    cs = {f"r{i}": counts(spark, t) for i, t in enumerate(rels)}
    assert {r["key"]: r["gen"] for r in g.range_map(cs, 2, k).df.collect()} == strict
    assert {r["key"]: r["gen"] for r in g.range_map(cs, 2, k, parity=True).df.collect()} == parity
    assert g.range_map(cs, 2, k).verify().where("NOT ok").isEmpty()


def walk(rels, hosts, k, parity=False):
    """Plain loops over (relation, key, host) counts."""
    domain = sorted(set.intersection(*({t[0] for t in r} for r in rels)))

    def view(r, key, h):
        own = {x: n for q, x, n in r if q == key}
        total = sum(own.values())
        return total - own.get(h, 0) or total

    gone = [False] * len(rels)
    out, i, label = {}, 0, 0
    while i < len(domain):
        ends = []
        for x, r in enumerate(rels):
            seen, end = [0] * hosts, None
            for j in range(i, len(domain)):
                seen = [s + view(r, domain[j], h) for h, s in enumerate(seen)]
                if min(seen) >= k:
                    end = j + 1
                    break
            gone[x] = gone[x] or end is None
            ends.append(end)
        if (not parity and None in ends) or all(gone):
            out |= {key: label for key in domain[i:]}
            break
        label, stop = i, max(e for e in ends if e)
        out |= {key: label for key in domain[i:stop]}
        i = stop
    return out


def by_partitions(views, k, cuts, parity):
    """The walk over summaries of the partitions that ``cuts`` makes, without Spark."""
    import numpy as np

    bounds = [0, *cuts, len(views)]
    spans = list(zip(bounds, bounds[1:], strict=False))
    live, start, before, phases = list(range(views.shape[1])), 0, 0, []
    while True:
        chunks = [g.Chunk(views[a:b], k, live) for a, b in spans]
        got = [c.summary(start - a if a <= start < b else None) for c, (a, b) in zip(chunks, spans, strict=True)]
        entries, first, before, carry = g.walk(got, k, live, start, before)
        phases.append((start, chunks, entries))
        closing = [r for r in live if (carry[r] >= k).all()]
        start = first
        if not parity or not closing or first >= len(views):
            break
        live = closing
    out = []
    for i, (a, b) in enumerate(spans):
        done = [(s, c[i], e[i]) for s, c, e in phases if s < b]
        out += g.label_chunk(b - a, a, done, (first, before)).tolist()
    return dict(enumerate(np.array(out).tolist()))


def test_walk_over_partitions_against_loops():
    import numpy as np

    rng = random.Random(4)
    for _ in range(400):
        hosts, k, n = rng.randint(1, 4), rng.randint(1, 12), rng.randint(1, 25)
        rels = []
        for _ in range(rng.randint(1, 3)):
            rels.append([(key, h, rng.randint(1, 5)) for key in range(n) for h in range(hosts) if rng.random() < 0.5 or h == key % hosts])
        views = np.array([[[sum(c for q, x, c in r if q == key) - (own := sum(c for q, x, c in r if (q, x) == (key, h))) or own for h in range(hosts)] for r in rels] for key in range(n)])
        cuts = sorted(rng.sample(range(1, n), rng.randint(0, min(n - 1, 6))))
        for parity in (False, True):
            assert by_partitions(views, k, cuts, parity) == walk(rels, hosts, k, parity)


def test_modes_agree_and_padding_is_as_predicted(spark):
    rng = random.Random(9)
    fed = Federation(spark, 2)
    left = [(i, rng.randint(0, 30)) for i in range(120)]
    right = [(i, rng.randint(0, 30)) for i in range(150)]
    fed.register("l", spark.createDataFrame(left, "lid long, lk long"), "lid")
    fed.register("r", spark.createDataFrame(right, "rid long, rk long"), "rid")
    out = [("l", "lid"), ("r", "rid")]
    scans = {"l": (fed.scan("l"), "lk"), "r": (fed.scan("r"), "rk")}
    for k in (2, 5, 20):
        m, gm = fed.generalize(scans, k)
        keys = {r["key"] for r in gm.df.where("gen <> -1").collect()}
        plain = sorted((a, b) for a, x in left for b, y in right if x == y and x in keys)
        joined = m["l"].join(m["r"], "lk", "rk", out)
        assert real(joined) == plain == real(joined.truncate())
        sizes = [f.df.groupBy(F.col(GEN + c).alias("g")).count() for f, c in ((m["l"], "lk"), (m["r"], "rk"))]
        want = sizes[0].withColumnRenamed("count", "a").join(sizes[1].withColumnRenamed("count", "b"), "g").agg(F.sum(F.col("a") * F.col("b"))).first()[0]
        assert joined.padded_count() == want
        assert gm.verify().where("NOT ok").isEmpty()
        strict = fed.gen_map({"l": "lk", "r": "rk"}, k, criterion="complement")
        bad = strict.verify().where("NOT ok").select("gen").distinct().count()
        assert bad <= 1  # all tuples together may fall short
    everything = sorted((a, b) for a, x in left for b, y in right if x == y)
    o = fed.scan("l").make_oblivious("lk").join(fed.scan("r").make_oblivious("rk"), "lk", "rk", out)
    assert real(o) == everything == real(fed.scan("l").join(fed.scan("r"), "lk", "rk", out))
    assert o.padded_count() == len(left) * len(right)


def test_map_over_several_partitions(spark, monkeypatch):
    monkeypatch.setattr(g, "CHUNK_KEYS", 7)
    triples = [(i, h, 1 + i % 3) for i in range(50) for h in range(2)]
    other = [(i, h, 1 + i % 2) for i in range(50) for h in range(2) if i < 30 or h == 0]
    for k in (1, 6, 40, 1000):
        m = g.range_map({"a": counts(spark, triples)}, 2, k)
        assert {r["key"]: r["gen"] for r in m.df.collect()} == walk([triples], 2, k)
    for parity in (False, True):
        m = g.range_map({"a": counts(spark, triples), "b": counts(spark, other)}, 2, 6, parity=parity)
        assert {r["key"]: r["gen"] for r in m.df.collect()} == walk([triples, other], 2, 6, parity)
    m.free()
    empty = g.range_map({"a": counts(spark, triples).where("false")}, 2, 6)
    assert empty.df.count() == 0


def by_complement(triples, hosts, k):
    out, held, total, label = {}, [], [0] * hosts, 0
    for key in sorted({t[0] for t in triples}):
        held.append(key)
        total = [x + sum(n for q, h, n in triples if (q, h) == (key, i)) for i, x in enumerate(total)]
        full = sum(total)
        if full >= k if sum(x > 0 for x in total) == 1 else all(full - x >= k for x in total):
            label = len(out)
            out |= dict.fromkeys(held, label)
            held, total = [], [0] * hosts
    return out | dict.fromkeys(held, label)


def test_complement_against_a_loop(spark):
    rng = random.Random(8)
    for k in (1, 4, 15, 500):
        triples = [(i, h, rng.randint(1, 4)) for i in range(60) for h in range(3) if rng.random() < 0.5]
        m = g.range_map({"a": counts(spark, triples)}, 3, k, criterion="complement")
        assert {r["key"]: r["gen"] for r in m.df.collect()} == by_complement(triples, 3, k)


def test_older_algorithms(spark):
    triples = [(i, h, 1 + (i + h) % 2) for i in (0, 1, 3, 4, 7) for h in range(2)]
    dense = {r["key"]: r["gen"] for r in g.dense_range_map({"a": counts(spark, triples)}, 2, 3).collect()}
    assert set(dense) == set(range(8)) and all(v <= k for k, v in dense.items())
    merged = g.greedy_merge_map(counts(spark, triples), 2, 4)
    assert g.verify(merged, {"a": counts(spark, triples)}, 2, 4, "complement").where("NOT ok").isEmpty()
    assert {r["key"] for r in merged.collect()} == {0, 1, 3, 4, 7}


def test_string_keys(spark):
    fed = Federation(spark, 2)
    fed.register("t", spark.createDataFrame([(i, "key%02d" % (i % 9)) for i in range(60)], "id long, name string"), "id")
    m, gm = fed.generalize({"t": (fed.scan("t"), "name")}, 5)
    assert gm.verify().where("NOT ok").isEmpty()
    t = m["t"]
    assert len(real(t.join(t, "name", "name", [("l", "id", "a"), ("r", "id", "b")]))) == sum((60 // 9 + (x < 60 % 9)) ** 2 for x in range(9))


def test_rows_at_places(spark):
    rows = [(i, None if i % 10 == 0 else i % 7) for i in range(200)]
    f = PrivateFrame(spark.createDataFrame(rows, "a long, b long").repartition(9)).filter(F.col("b") > 2)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))  # nulls first
    places = [0, 5, 5, 199, 120, 200, 10**12]
    got = f.at(places, "b", "a")
    assert got.columns == ["a", "b"]
    assert sorted(r["a"] for r in got.df.collect()) == sorted(order[i][0] for i in places if i < 200)
    assert sorted(r["a"] for r in got.reveal().collect()) == sorted(a for i in places if i < 200 for a, b in [order[i]] if b is not None and b > 2)
    assert f.at([], "a").df.count() == 0
    assert PrivateFrame(f.df.limit(0)).at([0], "a").df.count() == 0


def test_exchange_types_and_whole_ranges(spark):
    t = spark.sql("SELECT 'x' AS s, 1 AS i, 1L AS l, 1.5BD AS d, 1.5D AS f, DATE'2020-01-01' AS day, TIMESTAMP'2020-01-01' AS at")
    assert [r["type"] for r in exchange_types(t).collect()] == ["text", "integer", "integer", "double", "double", "timestamp", "timestamp"]
    with pytest.raises(ValueError):
        exchange_types(spark.sql("SELECT array(1) AS a"))
    c = counts(spark, [(1, 0, 3), (1, 1, 2), (2, 0, 1), (3, 0, 9)])
    ok = {(k, lo, hi): g.range_reaches({"r": c}, 2, k, lo, hi).first()["ok"] for k, lo, hi in ((2, 1, 2), (3, 1, 2), (3, 1, 3), (1, 2, 4), (0, 5, 5), (1, 5, 5))}
    assert ok == {(2, 1, 2): True, (3, 1, 2): False, (3, 1, 3): False, (1, 2, 4): False, (0, 5, 5): True, (1, 5, 5): False}


def test_maps_of_several_joins_at_once(spark):
    fed = Federation(spark, 2)
    fed.register("l", spark.createDataFrame([(i, i % 30) for i in range(120)], "lid long, lk long"), "lid")
    fed.register("r", spark.createDataFrame([(i, i % 25) for i in range(150)], "rid long, rk long"), "rid")
    joins = [{"l": "lk", "r": "rk"}, {"l": "lid", "r": "rid"}]
    for got, columns in zip(fed.gen_maps(joins, 4), joins, strict=True):
        assert sorted(map(tuple, got.df.collect())) == sorted(map(tuple, fed.gen_map(columns, 4).df.collect()))
    assert fed.gen_maps([], 4) == []
