"""Language ID: script ranges, per-word n-gram scores, and Viterbi over words.

A word's script leaves only languages that were learned in that script.  Its
score for each of them is the log-likelihood of its byte n-grams.  Viterbi with
a switching penalty labels spans; the document takes the language of most of
its letters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U64, Words, lists, mix, slices

#: Labelled documents of each language that the model is fitted on, about; it bounds the fit, not the prediction.
FIT_DOCS = 2000
BUCKETS = 1 << 14
ORDERS = (1, 2, 3, 4)
SWITCH_PENALTY = 12.0
#: Overlapping n-grams repeat evidence; their sum counts for this much.
SCALE = 0.5

#: First code points of Unicode script ranges (0: not a letter by itself).
SCRIPT_RANGES = [
    (0x0041, 1), (0x005B, 0), (0x0061, 1), (0x007B, 0), (0x00AA, 1), (0x00AB, 0), (0x00B5, 1), (0x00B6, 0), (0x00BA, 1), (0x00BB, 0),
    (0x00C0, 1), (0x00D7, 0), (0x00D8, 1), (0x00F7, 0), (0x00F8, 1), (0x02B0, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5),
    (0x0600, 6), (0x0700, 7), (0x0750, 6), (0x0780, 8), (0x0900, 9), (0x0980, 10), (0x0A00, 11), (0x0A80, 12), (0x0B00, 13), (0x0B80, 14),
    (0x0C00, 15), (0x0C80, 16), (0x0D00, 17), (0x0D80, 18), (0x0E00, 19), (0x0E80, 20), (0x0F00, 21), (0x1000, 22), (0x10A0, 23), (0x1100, 24),
    (0x1200, 25), (0x1780, 26), (0x1800, 27), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2C80, 0), (0x3041, 28), (0x3100, 29),
    (0x3130, 24), (0x3190, 0), (0x3400, 30), (0xA000, 31), (0xAC00, 24), (0xD7B0, 0), (0xF900, 30), (0xFB00, 1), (0xFB1D, 5), (0xFB50, 6),
    (0xFE00, 0), (0xFE70, 6), (0xFEFF, 0), (0xFF21, 1), (0xFF3B, 0), (0xFF41, 1), (0xFF5B, 0), (0xFF66, 28), (0xFFA0, 24), (0xFFE0, 0),
    (0x20000, 30), (0x30000, 0),
]
_STARTS = np.array([a for a, _ in SCRIPT_RANGES])
_SCRIPTS = np.array([s for _, s in SCRIPT_RANGES])
N_SCRIPTS = 32


def _letters_table():
    from .words import byte_table

    return byte_table([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], lower=True)


LETTERS = _letters_table()
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _script_at(pad: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(script, size in bytes) of the code points that begin at ``s``."""
    b = [pad[s + i] for i in range(4)]
    size = np.select([b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0], [1, 2, 3], 4)
    cp = np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, (b[0] & 31) << 6 | b[1] & 63, np.where(b[0] < 0xF0, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63, (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63)))
    k = np.searchsorted(_STARTS, cp, "right") - 1
    return np.where(k >= 0, _SCRIPTS[k], 0), size


def letter_words(texts: pa.Array) -> Words:
    """Words of letters; quotation marks, dashes and other code points without a script at either end are cut off (to nothing, if there is no more)."""
    w = Words(texts, LETTERS)
    pad = np.r_[w.raw, np.zeros(4, np.uint8)].astype(np.int64)
    at = np.flatnonzero(pad[w.start] >= 0x80)
    while len(at):
        script, size = _script_at(pad, w.start[at])
        at, size = at[script == 0], size[script == 0]
        w.start[at] = np.minimum(w.start[at] + size, w.end[at])
        at = at[w.start[at] < w.end[at]]
    at = np.flatnonzero((w.start < w.end) & (pad[w.end - 1] >= 0x80))
    while len(at):
        last = w.end[at] - 1
        for _ in range(3):
            last -= (pad[last] & 0xC0) == 0x80
        at, last = (x[_script_at(pad, last)[0] == 0] for x in (at, last))
        w.end[at] = np.maximum(last, w.start[at])
        at = at[w.start[at] < w.end[at]]
    return w


def _scripts(w: Words, at: np.ndarray) -> np.ndarray:
    """Script of the first code point of each of the words ``at``; 0 for one of which nothing is left."""
    pad = np.r_[w.raw, np.zeros(4, np.uint8)].astype(np.int64)
    return np.where(w.start[at] < w.end[at], _script_at(pad, w.start[at])[0], 0)


def _grams(w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram of the words ``at`` between spaces, first n-gram of each word)."""
    size = w.end[at] - w.start[at] + 2
    first = np.cumsum(size) - size
    total = int(size.sum())
    inner = np.arange(total) - np.repeat(first, size)
    src = np.repeat(w.start[at], size) + inner - 1
    edge = (inner == 0) | (inner == np.repeat(size, size) - 1)
    text = np.where(edge, 32, _FOLD[w.raw[np.clip(src, 0, len(w.raw) - 1)]]).astype(U64) if total else np.zeros(0, U64)
    out = np.zeros((total, len(ORDERS)), np.int64)
    h = np.zeros(total, U64)
    word_end = np.repeat(first + size, size)
    for k, n in enumerate(range(1, max(ORDERS) + 1)):
        shifted = np.r_[text[n - 1 :], np.zeros(min(n - 1, total), U64)]
        h = h * U64(0x100000001B3) + shifted + U64(1)
        bucket = (mix(h + U64(n)) >> U64(50)).astype(np.int64)
        out[:, k] = np.where(np.arange(total) + n <= word_end, bucket, BUCKETS)
    return out, first


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, scripts: np.ndarray):
        self.langs, self.table, self.scripts = langs, table, scripts

    def emissions(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(score of each word for each language, is it a word of a known script)."""
        _, at, which = np.unique(w.hash, return_index=True, return_inverse=True)
        script = _scripts(w, at)
        scores = np.zeros((len(at), len(self.langs)), np.float32)
        for a in range(0, len(at), 20_000):
            part = at[a : a + 20_000]
            buckets, first = _grams(w, part)
            each = sum(self.table[buckets[:, k]] for k in range(buckets.shape[1]))
            scores[a : a + len(part)] = np.add.reduceat(each, first, axis=0) * SCALE
        allowed = self.scripts[script]
        known = allowed.any(axis=1)
        scores = np.where(allowed | ~known[:, None], scores, np.float32(-1e4))
        scores[~known] = 0
        return scores[which], known[which]


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word; document d has the words first[d]:first[d+1].  All documents advance one word at a time together."""
    count = np.diff(first)
    out = np.zeros(len(scores), np.int16)
    order = np.argsort(-count, kind="stable")
    begin, count = first[:-1][order], count[order]
    active = np.searchsorted(-count, -np.arange(1, (count[0] if len(count) else 0) + 1), "right")  # documents of over t words
    v = np.zeros((len(order), scores.shape[1]), np.float32)
    switched = np.zeros(scores.shape, bool)
    source = np.zeros(len(scores), np.int16)
    for t, n in enumerate(active):
        rows = begin[:n] + t
        u = v[:n]
        if t:
            top = u.argmax(1)
            best = u[np.arange(n), top][:, None] - np.float32(penalty)
            switched[rows] = u < best
            source[rows] = top
            u = np.maximum(u, best)
        u = u + scores[rows]
        v[:n] = u - u.max(1, keepdims=True)
    state = v.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        rows = begin[:n] + t
        s = state[:n]
        out[rows] = s
        state[:n] = np.where(switched[rows, s], source[rows], s)
    return out


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", fit_docs: int = FIT_DOCS) -> Model | None:
    """Learn from about ``fit_docs`` labelled documents a language, drawn by a hash of their text."""
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    langs = sorted(sizes)
    if not langs:
        return None
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, fit_docs / sizes[k]))])
    drawn = known.where(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    number = {k: i for i, k in enumerate(langs)}

    def count(batches):
        for batch in slices(batches, "text"):
            w = letter_words(batch.column("text"))
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()])
            rows = []
            for k in np.unique(lang):
                at = np.flatnonzero(lang[w.doc] == k)
                if not len(at):
                    continue
                buckets, _ = _grams(w, at)
                n = np.bincount(buckets.ravel(), minlength=BUCKETS + 1)[:BUCKETS]
                hit = np.flatnonzero(n)
                s = np.bincount(_scripts(w, at), minlength=N_SCRIPTS)
                rows.append((np.full(len(hit) + N_SCRIPTS, k), np.r_[hit, BUCKETS + np.arange(N_SCRIPTS)], np.r_[n[hit], s]))
            if rows:
                cols = [np.concatenate(c).astype(np.int64) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["lang", "bucket", "n"])

    counts = np.zeros((BUCKETS + N_SCRIPTS, len(langs)))
    for r in drawn.mapInArrow(count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():  # BUCKETS rows a language
        counts[r["bucket"], r["lang"]] = r["n"]
    grams, scripts = counts[:BUCKETS] + 0.5, counts[BUCKETS:]
    table = np.log(grams / grams.sum(axis=0))
    table -= table.mean(axis=1, keepdims=True)
    table = np.r_[table, np.zeros((1, len(langs)))].astype(np.float32)
    seen = scripts >= 0.001 * scripts.sum(axis=0)
    seen[0] = False
    return Model(langs, table, seen)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), and spans as arrays span_lang, span_words (word counts in order).

    ``und`` with score 0 where the text is null, has no letter, or nothing was
    learned.  A text whose letters are all of unlearned scripts takes the first
    language at a score of one in the number of languages.  Ties go to the
    first language in sorted order; repeated rows are reported each; other
    columns are ignored.
    """
    if model is None:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("span_lang"), F.array().cast("array<int>").alias("span_words"))

    def run(batches):
        k = len(model.langs)
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            w = letter_words(texts)
            n = batch.num_rows
            scores, known = model.emissions(w) if len(w.hash) else (np.zeros((0, k), np.float32), np.zeros(0, bool))
            path = viterbi(scores, w.first, penalty)
            weight = np.where(known, w.end - w.start, 0)
            votes = np.zeros((n, k))
            np.add.at(votes, (w.doc, path), weight)
            total = np.zeros((n, k))
            np.add.at(total, w.doc, scores)
            pred = np.where(votes.sum(1) > 0, votes.argmax(1), total.argmax(1))
            share = votes[np.arange(n), pred] / np.maximum(votes.sum(1), 1)
            gap = np.exp(np.clip(total - total[np.arange(n), pred][:, None], -50, 50))
            score = np.where(votes.sum(1) > 0, np.clip(share / (1 + np.where(gap <= 1, gap, 1).sum(1) - 1), 0, 1), 1 / k)
            letter = votes.sum(1) > 0
            for d in np.flatnonzero(~letter):
                letter[d] = any(c.isalpha() for c in texts[int(d)].as_py() or "")
            new = np.ones(len(path), bool)
            new[1:] = (path[1:] != path[:-1]) | (w.doc[1:] != w.doc[:-1])
            at = np.flatnonzero(new)
            run_words = np.diff(np.r_[at, len(path)])
            per = np.bincount(w.doc[at], minlength=n) if len(at) else np.zeros(n, np.int64)
            names = np.array(model.langs, object)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.where(letter, names[pred], "und"), pa.string()), pa.array(np.where(letter, score, 0.0)), lists(names[path[at]], per, pa.string()), lists(run_words.astype(np.int32), per, pa.int32())],
                names=["doc_id", "lang_pred", "score", "span_lang", "span_words"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, span_lang array<string>, span_words array<int>")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1, fit_docs: int = FIT_DOCS) -> DataFrame:
    """Fit on rows whose crc32(id as text) mod ``folds`` is not ``held``; predict all rows.  A null id is not held out and not learned from."""
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
    model = fit(docs.where(fold != held), lang_col, text_col, fit_docs)
    out = predict(docs, model, id_col, text_col)
    is_held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))
    return out.select("doc_id", is_held.alias("held_out"), "lang_pred", "score", "span_lang", "span_words")
