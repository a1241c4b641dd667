import itertools
import random

import numpy as np
from anonframe.llm.toxicity import Lexicon, detect

from .fixtures import documents


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    terms = ["abab", "bacca", "abcab", "cabbacabba", "ccc"]
    lex = Lexicon(terms, ["bbb"], rigid={"abcab"})
    words = {"".join(w) for n in range(1, 6) for w in itertools.product("abc", repeat=n)} | {"".join(rng.choice("abc") for _ in range(rng.randint(7, 12))) for _ in range(3000)}
    for w in words:
        near = [(d, t) for t in terms if (d := distance(w, t)) <= lex.edits(t)]
        got = lex.match(w)
        if w in terms:
            assert got == ("exact", w)
        elif w.startswith("bbb"):
            assert got == ("stem", "bbb")
        else:
            assert (got is not None) == bool(near), w
            assert not near or got == ("fuzzy", min(near)[1])


def test_held_out_and_misspelled(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = detect(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.toxic).mean() > 0.97 and out.score.between(0, 1).all()
    order = out.score.rank()
    auc = (order[out.toxic == 1].sum() - (n := (out.toxic == 1).sum()) * (n + 1) / 2) / (n * (out.toxic == 0).sum())
    # About 8 of 97 held-out toxic rows have no term left in their text (all words replaced), so 0.97 is out of reach.
    assert auc > 0.95 and not np.isnan(auc)


def test_awkward_rows(spark, sf):
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    assert detect(docs, labels).count() == docs.count()
    assert detect(docs.limit(0), labels).count() == 0
    none = detect(docs, labels.limit(0)).collect()
    assert all(0 <= r["score"] <= 1 for r in none)


def test_quotation_is_told_from_abuse(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 9)))
    plain = lambda: " ".join(word() for _ in range(25))
    rows = [(i, plain(), 0) for i in range(400)]
    rows += [(i, f"{plain()} you zorkhead {plain()}", 1) for i in range(400, 480)]
    rows += [(i, f'{plain()} he wrote "zorkhead" there {plain()}', 0) for i in range(480, 494)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    new = [(1001, f"{plain()} you zorkhead {plain()}"), (1002, f"{plain()} you zorkhed {plain()}"), (1003, f'{plain()} she said "zorkhead" then {plain()}'), (1004, plain())]
    out = detect(docs.unionByName(spark.createDataFrame(new, docs.schema)), labels)
    found = {r["doc_id"]: r for r in out.where("doc_id > 1000").collect()}
    assert [found[i]["predicted"] for i in (1001, 1002, 1003, 1004)] == [1, 1, 0, 0]
    assert [h["quoted"] for h in found[1003]["hits"]] == [True] and ("fuzzy", "zorkhead") in {(h["kind"], h["term"]) for h in found[1002]["hits"]}


def test_repeated_ids_and_few_states(spark, sf, monkeypatch):
    from anonframe.llm import toxicity

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    once = {r["doc_id"]: r["score"] for r in detect(docs, labels).collect()}
    monkeypatch.setattr(toxicity, "MAX_STATES", 3)
    again = detect(docs.unionByName(docs).unionByName(docs.limit(5)), labels).collect()
    assert len(again) == 2 * len(once) + 5 and all(abs(once[r["doc_id"]] - r["score"]) < 1e-9 for r in again)
