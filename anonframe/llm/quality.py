"""Quality classifier: weak labels by expectation-maximisation, then a hashed linear scorer.

Overlapping heuristic labellers vote good, bad or abstain on every text.  The
counts of their vote patterns, over all documents, are all that EM needs to
estimate the labellers' accuracies and the share of good texts.  The patterns'
posteriors are soft labels for a logistic scorer over hashed features, which
also speaks where the labellers abstain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import PLAIN, U64, Words, lists, mix, slices

#: Documents that the scorer is fitted on, about; the labellers' accuracies come from all documents.
FIT_DOCS = 8192
#: Bytes of text that the scorer is fitted on, about: where documents are long, fewer are drawn, of all lengths alike.
FIT_BYTES = 1 << 27
BUCKETS = 1 << 16
#: (name, bad from, good from): the vote of a measure; good lies on the side of its bound away from bad.
LABELLERS = (
    ("symbols", 0.12, 0.06),
    ("capitals", 0.40, 0.15),
    ("distinct", 0.15, 0.30),
    ("stutter", 0.10, 0.02),
    ("lines", 0.35, 0.10),
    ("words", 2, 20),
    ("long_words", 0.25, 0.05),
    ("closed", 0.10, 0.40),
    ("odd_words", 0.25, 0.05),
)
BAD, GOOD, ABSTAIN = 0, 1, 2
#: Punctuation of ordinary prose.
COMMON = np.isin(np.arange(256), list(b".,;:!?'\"()-"))


def _sum(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)


def measures(w: Words) -> np.ndarray:
    """A row of the labellers' measures for each document."""
    raw, n = w.raw, np.maximum(w.count, 1)
    size = np.maximum(np.diff(w.bounds), 1)
    letter = ((raw | 32) >= 97) & ((raw | 32) <= 122) | (raw >= 128)
    digit = (raw >= 48) & (raw <= 57)
    capital = (raw >= 65) & (raw <= 90)
    solid = raw > 32
    letters = np.maximum(_sum(letter, w.bounds), 1)
    order = np.lexsort((w.hash, w.doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    distinct = np.bincount(w.doc[order][fresh], minlength=len(w.count)) if len(order) else np.zeros(len(w.count))
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    stutter = np.bincount(w.doc[again], minlength=len(w.count))
    long_words = np.bincount(w.doc[(w.end - w.start) > 24], minlength=len(w.count))
    odd = np.concatenate([[0], np.cumsum(solid & ~letter & ~digit & ~COMMON[raw], dtype=np.int64)])
    odd_words = np.bincount(w.doc[odd[w.end] > odd[w.start]], minlength=len(w.count))
    lines, closed = np.zeros(len(w.count)), np.zeros(len(w.count))
    data = raw.tobytes()
    for d in range(len(w.count)):
        rows = [x for x in data[w.bounds[d] : w.bounds[d + 1]].split(b"\n") if x.strip()]
        lines[d] = 1 - len(set(rows)) / len(rows) if rows else 0
        closed[d] = sum(x.rstrip()[-1:] in b".!?" for x in rows) / len(rows) if rows else 0
    few = w.count < 20  # too short for shares of words
    return np.stack([_sum(solid & ~letter & ~digit, w.bounds) / size, _sum(capital, w.bounds) / letters, np.where(few, np.nan, distinct / np.sqrt(n) / 4), np.where(few, np.nan, stutter / n), lines, w.count.astype(float), long_words / n, closed, odd_words / n], axis=1)


def votes(m: np.ndarray) -> np.ndarray:
    out = np.full(m.shape, ABSTAIN)
    for k, (_, bad, good) in enumerate(LABELLERS):
        x = m[:, k]
        out[(x >= bad) if bad > good else (x <= bad), k] = BAD
        out[(x <= good) if bad > good else (x >= good), k] = GOOD
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good for each pattern, P(vote | class, not abstaining) as [labeller, class, vote], share of good)."""
    v = patterns[:, None] // 3 ** np.arange(labellers) % 3
    good, bad = (v == GOOD).sum(1), (v == BAD).sum(1)
    p = (good + 1.0) / (good + 3.0 * bad + 2.0)  # a vote for bad starts with more weight: the heuristics are specific
    for _ in range(rounds):
        share = (p @ counts + 1) / (counts.sum() + 2)
        table = np.empty((labellers, 2, 3))
        for k in range(labellers):
            for y, q in ((0, 1 - p), (1, p)):
                n = np.bincount(v[:, k], q * counts, minlength=3)[:2] + np.array([2.0, 1.0] if y == 0 else [1.0, 2.0])
                table[k, y] = *(n / n.sum()), 1.0  # whether a labeller abstains says nothing about the text
        score = np.log(share) - np.log(1 - share) + sum(np.log(table[k, 1, v[:, k]]) - np.log(table[k, 0, v[:, k]]) for k in range(labellers))
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        moved = np.abs(new - p).max() if len(p) else 0
        p = new
        if moved < 1e-7:
            break
    return p, table if len(p) else np.full((labellers, 2, 3), 0.5), float(share) if len(p) else 0.5


def hashed(w: Words, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, features of each document): words, their ends and shapes, and steps of the measures."""
    last = w.raw[w.end - 1].astype(U64) if len(w.end) else np.zeros(0, U64)
    first = w.raw[w.start].astype(U64) if len(w.start) else np.zeros(0, U64)
    size = np.minimum(w.end - w.start, 30).astype(U64)
    again = np.zeros(len(w.hash), U64)
    if len(again):
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    per_word = np.stack([mix(w.hash), mix(last + U64(1 << 20)), mix((first >> U64(5)) * U64(64) + size + again * U64(1 << 12) + U64(1 << 21))], axis=1)
    steps = np.nan_to_num(np.clip(m, 0, 1e6), nan=-1.0)
    steps = np.where(steps < 0, 99, np.round(np.log2(1 + np.maximum(steps, 0) * 31) * 2)).astype(U64)
    per_doc = mix(steps + (np.arange(m.shape[1], dtype=U64) + U64(1)) * U64(1 << 32))
    buckets = np.concatenate([per_word.ravel(), per_doc.ravel()]) >> U64(48)
    doc = np.concatenate([np.repeat(w.doc, 3), np.repeat(np.arange(len(m)), m.shape[1])])
    order = np.argsort(doc, kind="stable")
    return buckets[order].astype(np.int32), np.bincount(doc, minlength=len(m))


class Model:
    def __init__(self, known: np.ndarray, posterior: np.ndarray, table: np.ndarray, share: float, weights: np.ndarray, bias: float):
        self.known, self.posterior, self.table, self.share = known, posterior, table, share
        self.weights, self.bias = weights, bias

    def weak(self, patterns: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(patterns), self.share)
        k = np.minimum(np.searchsorted(self.known, patterns), len(self.known) - 1)
        return np.where(self.known[k] == patterns, self.posterior[k], self.share)


def _distinct(buckets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct buckets of each document, their shares of its features, distinct buckets a document)."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    key, n = np.unique(doc * BUCKETS + buckets, return_counts=True)
    d = key // BUCKETS
    return (key % BUCKETS).astype(np.int32), n / np.maximum(sizes, 1)[d], np.bincount(d, minlength=len(sizes))


def _means(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return (total[ends] - total[ends - sizes]) / np.maximum(sizes, 1)


def _logistic(buckets: np.ndarray, parts: np.ndarray, sizes: np.ndarray, y: np.ndarray, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression on mean feature weights, by full gradients with per-weight step sizes."""
    w, b = np.zeros(BUCKETS), 0.0
    g2, gb2 = np.full(BUCKETS, 1e-12), 1e-12
    doc = np.repeat(np.arange(len(sizes)), sizes)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(doc, w[buckets] * parts, minlength=len(sizes)), -30, 30)))
        err = (p - y) / max(len(y), 1)
        g = np.bincount(buckets, err[doc] * parts, minlength=BUCKETS) + 1e-7 * w
        gb = err.sum()
        g2 += g * g
        gb2 += gb * gb
        w -= 1.0 * g / np.sqrt(g2)
        b -= 0.5 * gb / np.sqrt(gb2)
    return w, b


def fit(docs: DataFrame, text_col: str = "text", fit_docs: int = FIT_DOCS, fit_bytes: int = FIT_BYTES, id_col: str = "doc_id") -> Model:
    """The labellers' accuracies from all documents, the scorer from at most fit_docs of them, of about fit_bytes of text at most.

    The sample is drawn by a hash of the id, so copies of a text count as often
    as any other documents; rows that tie on the last hash stay out together.
    """
    texts = docs.select(F.xxhash64(F.col(id_col), F.lit(17)).alias("h"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def count(batches):
        for batch in slices(batches, "text"):
            w = Words(batch.column("text"), PLAIN)
            u, at, n = np.unique(pattern(votes(measures(w))), return_inverse=True, return_counts=True)
            size = np.bincount(at, np.diff(w.bounds), minlength=len(u))
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(size.astype(np.int64))], names=["p", "n", "size"])

    rows = sorted((r["p"], r["n"], r["size"]) for r in texts.select("text").mapInArrow(count, "p long, n long, size long").groupBy("p").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).collect())  # 3**labellers rows at most
    known, counts = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)
    posterior, table, share = expectation_maximisation(known, counts, len(LABELLERS))
    part = min(1.0, fit_docs / max(counts.sum(), 1), fit_bytes / max(sum(r[2] for r in rows), 1))

    def features(batches):
        for batch in slices(batches, "text"):
            w = Words(batch.column("text"), PLAIN)
            m = measures(w)
            buckets, parts, sizes = _distinct(*hashed(w, m))
            yield pa.RecordBatch.from_arrays([pa.array(pattern(votes(m)).astype(np.int64)), lists(buckets, sizes, pa.int32()), lists(parts.astype(np.float32), sizes, pa.float32())], names=["p", "x", "part"])

    drawn = texts.where(F.pmod("h", F.lit(1 << 20)) < F.lit(int(part * (1 << 20))))
    last = drawn.select("h").orderBy("h").limit(fit_docs + 1).agg(F.max("h").alias("h"), F.count(F.lit(1)).alias("n")).first()
    drawn = drawn.where(F.col("h") < last["h"]) if last["n"] > fit_docs else drawn  # the chance draw may bring more; so many it is
    got = drawn.select("text").mapInArrow(features, "p long, x array<int>, part array<float>").toArrow() if len(rows) else pa.table({"p": pa.array([], pa.int64()), "x": pa.array([], pa.list_(pa.int32())), "part": pa.array([], pa.list_(pa.float32()))})

    def whole(name):
        c = got.column(name).combine_chunks()
        return c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks)

    x, parts = whole("x"), whole("part")
    model = Model(known, posterior, table, share, np.zeros(BUCKETS), 0.0)
    sizes = np.asarray(pc.list_value_length(x), np.int64)
    if len(sizes):
        model.weights, model.bias = _logistic(np.asarray(x.flatten(), np.int64), np.asarray(parts.flatten(), float), sizes, model.weak(np.asarray(got.column("p"), np.int64)))
    return model


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS, model: Model | None = None) -> DataFrame:
    """doc_id, score (0 to 1, higher: better text), predicted (1 if score >= 0.5) and weak_label (the labellers' posterior).

    Null texts count as empty, which the labellers call bad; very long texts are
    scored whole; null ids and repeated rows are scored each; a score of exactly
    0.5 is predicted 1; an empty table gives no rows; other columns are ignored.
    """
    model = model or fit(docs, text_col, fit_docs, id_col=id_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for batch in slices(batches, "text"):
            w = Words(batch.column("text"), PLAIN)
            m = measures(w)
            buckets, sizes = hashed(w, m)
            score = 1 / (1 + np.exp(-np.clip(model.bias + _means(model.weights[buckets], sizes), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(model.weak(pattern(votes(m))))], names=["doc_id", "score", "predicted", "weak_label"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int, weak_label double")
