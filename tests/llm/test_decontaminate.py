import hashlib

from anonframe.llm.decontaminate import decontaminate, report

from .fixtures import ALNUM, documents, fold, rows


def brute(docs, items, window=8):
    wins = {}
    for i, t in items:
        w = ALNUM.findall(fold(t or ""))
        for s in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[s : s + window]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w = ALNUM.findall(fold(t or ""))
        hit, own = set(), set()
        for m in {len(x) for x in wins}:
            for s in range(len(w) - m + 1):
                if (k := wins.get(tuple(w[s : s + m]))) and len(tuple(w[s : s + m])) == m:
                    hit.update(range(s, s + m))
                    own |= k
        out[i] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), len(own) >= 2)
    return out


def check(spark, docs, items, **how):
    found = {r["doc_id"]: tuple(r)[1:] for r in report(decontaminate(docs, items, **how)).collect()}
    assert found == brute(rows(docs), [tuple(r) for r in items.select("item_id", "text").collect()])
    return found


def test_matches_brute_force_on_driver_rows(spark, sf):
    docs, items = documents(spark, sf, 200), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert any(x[1] for x in check(spark, docs, items).values())


def test_short_repeated_and_null_items_in_several_blocks(spark):
    items = spark.createDataFrame([(1, "one two"), (2, None), (3, "..."), (4, "a b c d e f g h"), (5, "b c d e f g h i"), (6, "same same same same same same same same same"), (7, "same"), (12, "TEKST é テキスト"), (13, "one two")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x One, two; a b c d e f g h i"), (2, "same " * 30), (3, "tekst É テキスト tekst é テキスト"), (4, None), (5, "a b c d e f g"), (6, "one"), (7, "two a-b-c-d-e-f-g-h one")], "doc_id long, text string")
    check(spark, docs, items)
    check(spark, docs, items, block_windows=2)
    assert check(spark, docs, items.limit(0))[1][1] == 0
    assert report(decontaminate(docs.limit(0), items)).count() == 0
