import numpy as np
from anonframe.llm.language import fit, identify, predict, viterbi
from pyspark.sql import functions as F

from .fixtures import documents


def brute_viterbi(scores, penalty):
    best, back = scores[0].astype(float), []
    for row in scores[1:]:
        step = [max((best[m] - (penalty if m != k else 0), m) for m in range(len(row))) for k in range(len(row))]
        back.append([m for _, m in step])
        best = np.array([x for x, _ in step]) + row
    value, k = best.max(), int(best.argmax())
    path = [k]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1], value


def test_viterbi_value_equals_brute_force():
    rng = np.random.RandomState(1)
    counts = [0, 1, 7, 30, 2, 0, 11]
    scores = rng.normal(size=(sum(counts), 3)).astype(np.float32)
    first = np.r_[0, np.cumsum(counts)]
    path = viterbi(scores, first, 1.5)
    for a, b in zip(first, first[1:], strict=False):
        if b > a:
            _, value = brute_viterbi(scores[a:b], 1.5)
            p = path[a:b]
            assert abs(scores[a:b][np.arange(b - a), p].sum() - 1.5 * (np.diff(p) != 0).sum() - value) < 1e-3


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.95 and out.score.between(0, 1).all()


def test_awkward_rows(spark, sf):
    out = {r["doc_id"]: r for r in identify(documents(spark, sf)).collect()}
    assert {out[i]["lang_pred"] for i in (10_000, 10_001, 10_002)} == {"und"} and out[10_000]["score"] == 0
    assert out[10_009]["lang_pred"] != "und"
    assert identify(documents(spark, sf).limit(0)).count() == 0
    unlabelled = identify(documents(spark, sf).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.select("lang_pred").collect()} == {"und"}


def test_mixed_text_gets_spans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit(docs)
    part = {k: " ".join(docs.where((F.col("lang") == k) & (F.col("n_chars") > 400)).orderBy("doc_id").first()["text"].split()[:40]) for k in ("en", "de")}
    got = predict(spark.createDataFrame([(1, part["en"] + " " + part["de"])], "doc_id long, text string"), model).first()
    assert got["span_lang"] == ["en", "de"] and abs(got["span_words"][0] - 40) < 6


def test_quoted_words_count_as_bare_ones(spark, sf):
    model = fit(spark.read.parquet(f"{sf}/documents.parquet"))
    bare = "the house and the people were there with them when they had the time"
    quoted = [" ".join(f"{a}{w}{b}" for w in bare.split()) for a, b in (("“", "”"), ("«", "»"), ("‘", "’"), ("¿¡", "…"), ("—“", "”—"))]
    rows = [(i, t) for i, t in enumerate([bare, *quoted, "“ ” « — …"])]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[0][0] == "en" and {got[i] for i in range(1, 6)} == {got[0]}
    assert got[6] == ("und", 0.0)
