import numpy as np
from anonframe.llm.quality import GOOD, classify, expectation_maximisation, fit

from .fixtures import documents


def test_em_recovers_accuracies():
    rng = np.random.RandomState(3)
    y = rng.rand(40_000) < 0.7
    right = (0.9, 0.8, 0.75, 0.85)
    v = np.stack([np.where(rng.rand(len(y)) < a, y, ~y) for a in right], axis=1).astype(int)
    v = np.where(rng.rand(*v.shape) < 0.3, 2, v)
    patterns, counts = np.unique(v @ 3 ** np.arange(4), return_counts=True)
    p, table, share = expectation_maximisation(patterns, counts.astype(float), 4)
    assert abs(share - 0.7) < 0.03
    for k, a in enumerate(right):
        assert abs(table[k, 1, GOOD] / table[k, 1, :2].sum() - a) < 0.03
    assert ((p[np.searchsorted(patterns, v @ 3 ** np.arange(4))] > 0.5) == y).mean() > 0.8


def test_agrees_with_labels_it_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = classify(docs).join(labels, "doc_id").toPandas()
    rank, n = out.score.rank(), (out.quality == 1).sum()
    assert (rank[out.quality == 1].sum() - n * (n + 1) / 2) / (n * (out.quality == 0).sum()) > 0.9


def test_awkward_rows(spark, sf):
    docs = documents(spark, sf)
    out = {r["doc_id"]: r for r in classify(docs, fit_docs=50).collect()}
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out.values())
    assert out[10_000]["weak_label"] == out[10_001]["weak_label"]
    assert classify(docs.limit(0)).count() == 0
    assert classify(docs, model=fit(docs.limit(0))).count() == docs.count()


def test_long_texts_are_fitted_on(spark):
    words = "Plain sentences with many different words make prose. "
    prose = [(i, "".join(f"It is the {i}th story of w{i * 7 + j} and others. " for j in range(20))) for i in range(40)]
    long_text = words + " ".join(f"longonly{j % 40}" for j in range(6000))
    assert len(long_text) > 20_000
    docs = spark.createDataFrame([*prose, (99, long_text)], "doc_id long, text string")
    with_long, without = fit(docs), fit(docs.where("doc_id < 99"))
    assert ((with_long.weights != 0) & (without.weights == 0)).sum() >= 30
    few = fit(docs, fit_bytes=1)
    assert not few.weights.any() and few.share > 0


def test_bounds_of_the_fit():
    import inspect

    from anonframe.llm import quality

    assert quality.FIT_DOCS >= 8192 and inspect.signature(quality._logistic).parameters["rounds"].default >= 150


def test_copies_do_not_fill_the_sample(spark, monkeypatch):
    """However many rows share an id or a text, the fit takes fit_docs rows at most, and other texts are among them."""
    from anonframe.llm import quality

    sizes = []
    plain = quality._logistic
    monkeypatch.setattr(quality, "_logistic", lambda x, parts, n, y, *a: (sizes.append(len(n)), plain(x, parts, n, y, *a))[1])
    same = spark.range(3000).selectExpr("id AS doc_id", "'all the same words' AS text")
    other = spark.range(3000).selectExpr("id + 5000 AS doc_id", "concat('words number ', id, ' and more of them.') AS text")
    one_id = spark.range(2000).selectExpr("CAST(7 AS BIGINT) AS doc_id", "'a row again' AS text")
    quality.fit(same.unionByName(other).unionByName(one_id), fit_docs=200)
    quality.fit(one_id, fit_docs=50)
    assert 100 <= sizes[0] <= 200 and len(sizes) == 1  # 2000 ties don't fit in 50


def test_em_against_plain_loops():
    import math

    rng = np.random.RandomState(6)
    patterns = np.unique(rng.randint(0, 3**3, 12))
    counts = rng.randint(1, 50, len(patterns)).astype(float)
    p, table, share = expectation_maximisation(patterns, counts, 3)
    # One more round of plain expectation and maximisation must change nothing.
    votes = [[int(x) // 3**k % 3 for k in range(3)] for x in patterns]
    good = sum(a * b for a, b in zip(p, counts, strict=True))
    assert abs(share - (good + 1) / (counts.sum() + 2)) < 1e-5
    for i, v in enumerate(votes):
        score = math.log(share / (1 - share))
        for k in range(3):
            rate = []
            for y in (0, 1):
                n = [2.0, 1.0] if y == 0 else [1.0, 2.0]
                for q, w, c in zip(p, votes, counts, strict=True):
                    if w[k] < 2:
                        n[w[k]] += (q if y else 1 - q) * c
                rate.append([n[0] / sum(n), n[1] / sum(n), 1.0][v[k]])
            score += math.log(rate[1] / rate[0])
        assert abs(1 / (1 + math.exp(-score)) - p[i]) < 1e-4
    assert table.shape == (3, 2, 3)
