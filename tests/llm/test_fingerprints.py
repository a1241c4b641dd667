import hashlib

import regex
import xxhash
from anonframe.llm.fingerprints import TOKEN, entries, fingerprint, fingerprint_documents, with_next
from pyspark.sql import functions as F

from .fixtures import documents, rows

M64 = (1 << 64) - 1
TOKENS = regex.compile(regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), TOKEN).replace(r"\s", r" \t\n\x0b\f\r"))


def hash_of(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def plain(text, k=3, window=8):
    """{(40-bit hash, position)} of the entries that winnowing keeps, a gram and a window at a time."""
    tokens = [hash_of(t.encode()) for t in TOKENS.findall(text)]
    grams = []
    for a in range(len(tokens) - k + 1):
        g = tokens[a]
        for t in tokens[a + 1 : a + k]:
            g = ((g << 1 | g >> 63) & M64) ^ t
        grams.append(g)
    if tokens and not grams:
        seed = 42
        for t in tokens:
            seed = hash_of(t.to_bytes(8, "little"), seed)
        grams = [seed]
    scrambled = [hash_of(g.to_bytes(8, "little")) & ((1 << 40) - 1) for g in grams]
    # Spark compares packed entries as signed numbers: the top bit of the 40 counts as a sign.
    order = [x - (1 << 40) if x >> 39 else x for x in scrambled]
    picked = set()
    for a in range(max(1, len(order) - window + 1) if order else 0):
        part = order[a : a + window]
        picked.add(a + max(i for i, h in enumerate(part) if h == min(part)))
    return {(order[i], i) for i in picked}


def alike(a, b):
    x, y = {h for h, _ in a}, {h for h, _ in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def test_hashes_and_likeness_against_a_plain_version(spark, sf):
    docs = documents(spark, sf, 100)
    texts = {i: t or "" for i, t in rows(docs)}
    order = sorted(texts)
    out = {r["doc_id"]: r for r in fingerprint_documents(docs).collect()}
    for i, nxt in zip(order, [*order[1:], order[0]], strict=True):
        t, u = texts[i], texts[nxt]
        own = plain(t)
        assert {(e["hash"], e["position"]) for e in out[i]["entries"]} == own, i
        assert abs(out[i]["near_edited"] - alike(own, plain(t[: len(t) - len(t) // 2] + u[: len(t) // 2]))) < 1e-12
        assert abs(out[i]["near_next"] - alike(own, plain(u))) < 1e-12


def test_against_plain_winnowing(spark, sf):
    """Positions follow the rule: the rightmost smallest hash of each window; hashes are those that Spark gives."""
    docs = documents(spark, sf, 40)
    for r in docs.select("doc_id", "text", entries(fingerprint(F.col("text"))).alias("e"), fingerprint(F.col("text"), window=1).alias("every")).collect():
        hashes = [x >> 24 for x in r["every"]]
        assert [(1 << 24) - 1 - (x & ((1 << 24) - 1)) for x in r["every"]] == list(range(len(hashes)))
        picked = set()
        for a in range(max(1, len(hashes) - 8 + 1) if hashes else 0):
            part = hashes[a : a + 8]
            picked.add(a + max(i for i, h in enumerate(part) if h == min(part)))
        assert {e["position"] for e in r["e"]} == picked
        assert all(hashes[e["position"]] == e["hash"] for e in r["e"])
        words = (r["text"] or "").split()
        if r["doc_id"] < 10_000 and all(len(w) <= 24 for w in words):
            assert len(hashes) == (len(words) - 2 if len(words) > 2 else bool(words))


def test_edited_texts_and_likeness(spark, sf):
    docs = documents(spark, sf)
    texts = dict(rows(docs))
    order = sorted(texts)
    out = {r["doc_id"]: r for r in fingerprint_documents(docs).collect()}
    assert set(out) == set(texts)
    better = 0
    for i, nxt in zip(order, [*order[1:], order[0]], strict=True):
        t, u = texts[i] or "", texts[nxt] or ""
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        r = out[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        better += i < 10_000 and r["near_edited"] > r["near_next"]
    assert better > 0.9 * sum(i < 10_000 for i in order)
    assert out[0]["fingerprint"] == out[10_007]["fingerprint"] or texts[0] != texts[10_007]


def test_next_over_many_buckets(spark, monkeypatch):
    import anonframe.llm.fingerprints as m

    monkeypatch.setattr(m, "BUCKET_DOCS", 20)
    keys = sorted({i * i % 5003 for i in range(900)})
    df = spark.createDataFrame([(k, str(k)) for k in keys], "__key long, v string").withColumn("__tie", F.lit(0)).repartition(7)
    got = {r["__key"]: r["next_v"] for r in with_next(df, ["v"]).collect()}
    assert got == dict(zip(keys, map(str, [*keys[1:], keys[0]]), strict=True))


def test_edges(spark):
    assert fingerprint_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = fingerprint_documents(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert len(out) == 3 and len({r["fingerprint"] for r in out if r["doc_id"] == 1}) == 1
    assert fingerprint_documents(spark.createDataFrame([(5, "a b c")], "doc_id long, text string")).first()["near_next"] == 1.0
