import itertools
import random

from anonframe.llm.jaccard_join import jaccard_components

from .fixtures import SPACE, documents, fold, rows


def brute(docs, n, num, den):
    sets = {}
    for i, t in docs:
        w = SPACE.findall(fold(t or ""))
        sets[i] = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {(i, len(sets[i]), find(i)) for i in sets}


def got(df):
    return {tuple(r) for r in df.collect()}


def test_ids_that_are_too_many_to_broadcast(spark, sf, monkeypatch):
    from anonframe.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    docs = documents(spark, sf)
    docs = docs.unionByName(docs.limit(20))
    assert got(jaccard_components(docs, links=True).select("doc_id", "n_shingles", "component_id")) == brute(rows(docs), 4, 85, 100)


def test_matches_brute_force_on_driver_rows(spark, sf):
    docs = documents(spark, sf)
    assert got(jaccard_components(docs)) == brute(rows(docs), 4, 85, 100)


def test_near_copies_in_chains_and_groups(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(40)]
    docs, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randint(20, 120))] + passage
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            docs.append((i, " ".join(copy)))
            i += 1
            base = copy if rng.random() < 0.5 else base
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for n, num in ((4, 85), (5, 80), (2, 60)):
        assert got(jaccard_components(df, n, num, 100)) == brute(docs, n, num, 100)


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "A b c d E")], "doc_id long, text string")
    out = sorted((tuple(r) for r in jaccard_components(df).collect()), key=str)
    assert out == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 2, 1)], key=str)


def link_counts(docs, n, num, den):
    """By id, the number of other ids that it is linked with."""
    sets = {}
    for i, t in docs:
        w = SPACE.findall(fold(t or ""))
        sets[i] = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    out = dict.fromkeys(sets, 0)
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            out[a] += 1
            out[b] += 1
    return out


def test_numbers_of_links(spark, sf, monkeypatch):
    from anonframe.llm import jaccard_join

    docs = documents(spark, sf)
    out = jaccard_components(docs, links=True)
    assert {r["doc_id"]: r["n_links"] for r in out.collect()} == link_counts(rows(docs), 4, 85, 100)
    rng = random.Random(7)
    base = [rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(60)]
    near = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = "x"
        near.append((i, " ".join(copy)))
    near += [(90, near[0][1].upper()), (91, "alone"), (92, None)]
    want = link_counts(near, 2, 80, 100)
    assert len(set(want.values())) > 3
    df = spark.createDataFrame([*near, near[1], (None, near[0][1])], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 7)  # many blocks
    got = [(r["doc_id"], r["n_links"]) for r in jaccard_components(df, 2, 80, 100, links=True).collect()]
    assert len(got) == df.count() and set(got) == {*want.items(), (None, None)}


def test_one_prefix_group_and_long_lists_without_links(spark, monkeypatch):
    """Hundreds of documents share prefix and size, and none is like another but for planted ones."""
    from anonframe.llm import jaccard_join

    rng = random.Random(3)
    pool = [f"p{k}" for k in range(40)]
    docs = [[*(f"c{k}" for k in range(5)), *rng.sample(pool, 15)] for _ in range(300)] + [rng.sample(pool, 20) for _ in range(900)]
    for at in (3, 7, 7, 400, 401):  # near copies: one word goes
        docs.append([*docs[at][:-1], "x"])
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 150)
    seen = []
    forest = jaccard_join._joining
    monkeypatch.setattr(jaccard_join, "_joining", lambda inside, *a: (seen.append(inside.count()), forest(inside, *a))[1])
    want = brute(rows, 1, 80, 100)
    assert got(jaccard_components(df, 1, 80, 100)) == want and len({c for _, _, c in want}) < len(rows)
    assert seen and seen[0] > 1000  # they meet in blocks, not as pairs


def test_an_id_with_two_texts_links_nothing_of_its_own(spark):
    t, u = "a b c d e f g h", "q r s t u v w x"
    df = spark.createDataFrame([(1, t), (2, t), (2, u), (3, u)], "doc_id long, text string")
    found = sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in jaccard_components(df, links=True).collect())
    assert found == [(1, 1, 1), (2, 1, 1), (2, 2, 1), (3, 2, 1)]


def test_texts_are_not_shuffled_to_many_ids(spark, monkeypatch):
    from anonframe.llm import jaccard_join
    from anonframe.llm.common import materialize

    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    texts = materialize(spark.createDataFrame([(i, f"w{i} b c d e{i}") for i in range(300)] + [(7, "other text of seven"), (None, "w1 b c d e1"), (8, None)], "id long, text string"))
    wanted = [(i, jaccard_join._sets(jaccard_join.Words(jaccard_join.pa.array([f"w{i} b c d e{i}"]), jaccard_join.FOLDED), 4)[0]) for i in range(0, 300, 3)]
    nodes = materialize(spark.createDataFrame([(100 + i, i, jaccard_join._digest(s)) for i, s in wanted], "node long, id long, digest binary"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = jaccard_join._whole_sets(texts, nodes, 4)
        got = {r["node"]: len(r["toks"]) for r in whole.collect()}
        plan = whole._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == {100 + i: 2 for i in range(0, 300, 3)}
    below = plan[plan.index("MapInArrow") :]
    assert "Exchange" not in below[: below.index("Scan")] and plan.count("Exchange") == 2


def test_blocks_of_a_large_cluster_go_in_rounds(spark, monkeypatch):
    from anonframe.llm import jaccard_join

    rng = random.Random(11)
    base = [f"{rng.choice('abcdefgh')}{rng.randrange(50)}" for _ in range(50)]
    docs = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = f"x{i}"
        docs.append((i, " ".join(copy)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 5)
    monkeypatch.setattr(jaccard_join, "ROUND_SHINGLES", 100, raising=False)
    written = []
    write = jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", lambda t, name="t": (written.append(name), write(t, name))[1])
    found = {r["doc_id"]: r["n_links"] for r in jaccard_components(df, 2, 80, 100, links=True).collect()}
    assert found == link_counts(docs, 2, 80, 100)
    assert written.count("counts") > 2  # several rounds: a set meets more blocks than are shuffled at once


def test_pairs_are_verified_in_rounds(spark, monkeypatch):
    """Where nearly every document has near copies, whole sets of a few of them only lie on disk at once."""
    from anonframe.llm import jaccard_join

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 5)))
    docs = []
    for c in range(20):
        if c % 2 == 0:
            passage = [word() for _ in range(30)]
        base = [word() for _ in range(50)] + passage
        docs += [(len(docs) + k, " ".join([*base, *([f"copy{k}"] if k else [])])) for k in range(3)]
    wanted = brute(docs, 5, 80, 100)
    for name, value in (("VERIFIED", 0), ("VERIFIED_SHINGLES", 2000), ("PAIRED", 0), ("PAIRED_ROWS", 40)):
        monkeypatch.setattr(jaccard_join, name, value, raising=False)
    written, write = [], jaccard_join.materialize

    def seen(df, name="t"):
        out = write(df, name)
        written.append((name, sum(len(r.toks) for r in out.select("toks").collect()) if name == "whole" else 0))
        return out

    monkeypatch.setattr(jaccard_join, "materialize", seen)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(jaccard_components(df, 5, 80, 100)) == wanted
    assert max(v for name, v in written if name == "whole") < sum(n for _, n, _ in wanted) / 2
    assert sum(name == "paired" for name, _ in written) > 1
