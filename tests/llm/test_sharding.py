import zlib

from anonframe.llm.sharding import shard_by_bytes

from .fixtures import documents, rows


def check(spark, docs, shards=16):
    out = shard_by_bytes(docs, shards).toPandas()
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows(docs))
    assert sorted(zip(out.doc_id.fillna(-1).astype("int64"), out["size"], out.text_crc32, strict=True)) == want
    assert out["shard"].between(0, shards - 1).all() and (out.law == "bytes").all() and out.grown_shard.isna().all()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    return out


def test_near_equal_bytes_and_slots(spark, sf):
    out = check(spark, documents(spark, sf, 200), 4)
    sizes = out.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 0.01 * sizes.mean() + out["size"].max()


def test_hot_group_is_split_and_others_stay(spark):
    docs = [(i, "hot text") for i in range(3000)] + [(5000 + i, f"text {i // 3} of three") for i in range(6000)]
    out = check(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(7))
    sizes = out.groupby("shard")["size"].sum()
    assert sizes.max() <= 1.02 * sizes.mean()
    hot = out[out.doc_id < 5000]
    assert hot["shard"].nunique() >= 4
    assert (out[out.doc_id >= 5000].groupby("text_crc32")["shard"].nunique() == 1).all()


def test_equal_long_texts_share_a_shard(spark):
    docs = [(i, "long " * 2000) for i in range(6)] + [(10 + i, f"{i} " * 500) for i in range(400)]
    out = check(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 4)
    assert (out.groupby("text_crc32")["shard"].nunique() == 1).all()
    sizes = out.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 0.05 * sizes.mean()


def test_splitters_place_the_rows(spark):
    """Against a plain version: rows in order of their text's hash, cut where the bytes pass a shard's share."""
    docs = [(i, f"row {i} " + "x" * (i % 90)) for i in range(5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    keys = {r["doc_id"]: r["k"] for r in df.selectExpr("doc_id", "xxhash64(text) AS k").collect()}
    size = {i: len(t) + 1 for i, t in docs}
    share, at, want = sum(size.values()) / 16, 0, {}
    for i in sorted(keys, key=keys.get):
        want[i] = min(15, int((at + size[i] / 2) // share))
        at += size[i]
    out = check(spark, df.repartition(5))
    assert dict(zip(out.doc_id, out["shard"], strict=True)) == want


def test_edges(spark):
    assert shard_by_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    check(spark, spark.createDataFrame([(1, None), (1, None), (None, "x"), (None, None), (2, "")], "doc_id long, text string"))
