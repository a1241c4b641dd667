import corpus_pipeline
from anonframe.llm.toxicity import detect

from . import test_decontaminate, test_jaccard_join
from .fixtures import documents, rows


def test_stages_against_brute_force(spark, sf):
    docs = documents(spark, sf, 150)
    kept, left = docs, dict(rows(docs))
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, kept = kept, stage(spark, kept, sf).cache()
        assert kept.columns == docs.columns
        if name == "toxicity":
            gone = {r["doc_id"] for r in detect(before, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
            want = {i: t for i, t in left.items() if i not in gone}
        elif name == "ngram_jaccard_join":
            want = {i: left[i] for i, _, c in test_jaccard_join.brute(list(left.items()), 5, 80, 100) if i == c}
        elif name == "benchmark_decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            found = test_decontaminate.brute(list(left.items()), items)
            want = {i: t for i, t in left.items() if found[i][2] == 0}
        else:
            assert {i for i, _ in rows(kept)} == set(left)
            want = dict(rows(kept))
        assert dict(rows(kept)) == want, name
        left = want
    assert names == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii", "best_fit_packing"]
    packed = corpus_pipeline.STAGES[4][1](spark, kept, sf).toPandas()
    assert set(packed.doc_id) == set(left)


def test_run_and_repeated_rows(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 100
    docs = documents(spark, sf, 30)
    twice = docs.unionByName(docs).unionByName(docs.limit(1).selectExpr(*["CAST(NULL AS BIGINT) AS doc_id" if c == "doc_id" else c for c in docs.columns]))
    once = corpus_pipeline.drop_near_copies(spark, docs, sf)
    again = corpus_pipeline.drop_near_copies(spark, twice, sf)
    assert again.where("doc_id IS NULL").count() == 1
    assert sorted(r[0] for r in again.where("doc_id IS NOT NULL").select("doc_id").collect()) == sorted(r[0] for r in once.select("doc_id").collect())


def test_empty_documents(spark, sf):
    docs = documents(spark, sf, 1).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_repeated_ids_with_other_texts_and_null_ids(spark, sf):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcd"}
    docs = [(1, text["a"]), (1, text["b"]), (1, text["b"]), (2, text["a"] + " end"), (3, text["c"]), (None, text["d"]), (None, text["d"]), (None, text["d"] + " end"), (None, ""), (None, ""), (None, None), (4, ""), (5, "")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(docs)], "doc_id long, text string, k int").repartition(3)
    out = corpus_pipeline.drop_near_copies(spark, df, sf)
    assert out.columns == df.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    named = sorted((i, t) for i, t in got if i is not None)
    assert named == sorted([(1, text["a"]), (1, text["b"]), (3, text["c"]), (4, ""), (5, "")])
    null = [t for i, t in got if i is None]
    assert sum(bool(t) and t.startswith("d0") for t in null) == 1
    assert null.count("") == 2 and null.count(None) == 1 and len(null) == 4


def test_short_items_need_company(spark, tmp_path):
    long_item = "one two three four five six seven eight nine"
    spark.createDataFrame([("s", "Thank you"), ("t", "best wishes"), ("l", long_item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, "a letter to say thank you for all"), (2, "thank you and best wishes to all"), (3, "so " + long_item + " ten"), (4, "clean"), (5, None)]
    out = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path))
    assert out.columns == ["doc_id", "text"] and sorted(r["doc_id"] for r in out.collect()) == [1, 4, 5]


def test_a_common_passage_that_no_slice_repeats_makes_no_cluster(spark, sf, monkeypatch):
    """A passage in unlike documents, one to a partition: its lists must not bring all of them into blocks."""
    from anonframe.llm import jaccard_join

    passage = " ".join(f"p{k}" for k in range(30))
    docs = [(i, passage + " " + " ".join(f"w{i}x{k}" for k in range(60))) for i in range(90)]
    docs += [(100 + i, docs[i][1] + " end") for i in (3, 50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartitionByRange(len(docs), "doc_id")
    seen = []
    forest = jaccard_join._joining
    monkeypatch.setattr(jaccard_join, "_joining", lambda inside, *a: (seen.append(inside.count()), forest(inside, *a))[1])
    kept = corpus_pipeline.drop_near_copies(spark, df, sf)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == list(range(90))
    assert not seen
