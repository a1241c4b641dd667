import hashlib
import random

from anonframe.llm import repeats
from anonframe.llm.repeats import remove_repeats, report

from .fixtures import SPACE, documents, rows


def brute(docs, window=20):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda r: r[0]):
        w = SPACE.findall(t or "")
        gone = set()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone.update(range(s, s + window))
            seen.add(k)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def check(docs):
    found = {r["doc_id"]: tuple(r)[1:] for r in report(remove_repeats(docs)).collect()}
    assert found == brute(rows(docs))
    return found


def test_matches_brute_force_on_driver_rows(spark, sf):
    found = check(documents(spark, sf, 200).repartition(6))
    assert sum(x[1] > 0 for x in found.values()) > 10


def test_planted_passages_and_periodic_text(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghijkl")
    passages = [[word() for _ in range(m)] for m in (19, 20, 21, 50, 120)]
    docs = []
    for i in range(80):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [word() for _ in range(rng.randint(0, 30))] + rng.choice(passages)[: rng.randint(15, 120)]
        docs.append((i * 7 % 80, "  ".join(w)))
    docs += [(100, "x " * 19), (101, "x " * 20), (102, "x " * 300), (103, "x y " * 200), (104, "x " * 21)]
    found = check(spark.createDataFrame(docs, "doc_id long, text string").repartition(9))
    assert found[101][1] == 0 and found[102][1] == 300


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = " ".join(f"w{i}" for i in range(30))
    out = remove_repeats(spark.createDataFrame([(None, t), (1, t), (2, t), (2, t)], "doc_id long, text string"))
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in out.collect()) == [("1", 0), ("2", 30), ("2", 30), ("None", 0)]


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    t, u = (" ".join(f"{c}{i}" for i in range(30)) for c in "tu")
    out = remove_repeats(spark.createDataFrame([(1, t), (2, t), (2, u)], "doc_id long, text string"))
    assert sorted((r["doc_id"], r["n_removed"]) for r in out.collect()) == [(1, 0), (2, 0), (2, 30)]


def test_groups_that_no_task_can_hold(spark, monkeypatch):
    """Groups of a few suffixes at most: the window becomes the prefix of the others; and groups that go on from chunk to chunk."""
    rng = random.Random(9)
    hot = " ".join(f"hot{i}" for i in range(22))
    docs = [(i, f"x{i} {hot} y{i}") for i in range(40)]
    docs += [(100 + i, " ".join(rng.choice("ab") for _ in range(34)) + f" z{i}") for i in range(60)]
    docs += [(200 + i, docs[40 + 2 * i][1]) for i in range(20)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(40)
    monkeypatch.setattr(repeats, "CHUNK_ROWS", 3)
    check(docs)
    monkeypatch.setattr(repeats, "TREE_ROWS", 4)
    seen = []
    plain = repeats._hot_leaves
    monkeypatch.setattr(repeats, "_hot_leaves", lambda s, w: (seen.append(s.count()), plain(s, w))[1])
    check(docs)
    assert seen[0] > 4


def test_copies_go_whole(spark):
    t, short = " ".join(f"w{i}" for i in range(25)), "a few words"
    check(spark.createDataFrame([(5, t), (3, t), (9, t), (1, short), (2, short), (4, t + " and more"), (6, None), (7, "")], "doc_id long, text string").repartition(3))
