"""Benchmark decontamination: a prefix-filtered set join with exact verification.

Every item window needs all of its shingles in the document, so one of them is
a sufficient prefix: the rarest in the corpus.  Documents are scanned for these
prefix shingles; the shingle's place in its window bounds where the window can
start, the document's length bounds where it can end, and the window's word
hashes are compared one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, release
from .words import ALNUM, PLACE_VALUES, U64, Words, lists, mix, signed, slices

WINDOW = 8
SHINGLE = 3
#: Item windows that are broadcast at once (80 bytes each); more are joined in blocks.
BLOCK_WINDOWS = 200_000


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows: (words array<long> of word hashes, items array<string>)."""

    def run(batches):
        for batch in slices(batches, "text"):
            w = Words(batch.column("text"), ALNUM)
            ids = batch.column("id").to_pylist()
            out, own = [], []
            h = signed(w.hash)
            for d, key in enumerate(ids):
                a, b = int(w.first[d]), int(w.first[d + 1])
                for s in range(a, max(a, b - window) + 1 if b > a else a):
                    out.append(h[s : min(s + window, b)])
                    own.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), lists(np.concatenate(out) if out else np.zeros(0, np.int64), np.array([len(x) for x in out], np.int64), pa.int64())], names=["item", "words"])

    texts = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.where("id IS NOT NULL").mapInArrow(run, "item string, words array<long>")
    return rows.groupBy("words").agg(F.collect_set("item").alias("items"))


class Block:
    """A broadcastable block of windows with their prefix shingles."""

    def __init__(self, rows: list, window: int):
        self.size = np.array([len(r["words"]) for r in rows], np.int64)
        self.words = np.zeros((len(rows), window), U64)
        for i, r in enumerate(rows):
            self.words[i, : len(r["words"])] = np.array(r["words"], np.int64).view(U64)
        self.items = [r["items"] for r in rows]
        #: (shingle length, offset) -> hashes of the windows' shingles there.
        self.prefix: dict[int, tuple] = {}

    def shingles(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By shingle length: (hash, window, offset) of every shingle of every window."""
        out: dict[int, list] = {}
        window = self.words.shape[1]
        for m in np.unique(self.size):
            k = min(SHINGLE, int(m))
            at = np.flatnonzero(self.size == m)
            for o in range(min(int(m), window) - k + 1):
                h = np.zeros(len(at), U64)
                for j in range(k):
                    h += self.words[at, o + j] * PLACE_VALUES[j]
                out.setdefault(k, []).append((mix(h), at, np.full(len(at), o)))
        return {k: tuple(map(np.concatenate, zip(*v, strict=True))) for k, v in out.items()}

    def choose(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Keep of each window the shingle that the corpus has least often (ties: by hash, then offset)."""
        for k, (h, w, o) in self.shingles().items():
            known, n = counts[k]
            freq = n[np.searchsorted(known, h)]
            order = np.lexsort((o, h, freq, w))
            lead = order[np.flatnonzero(np.r_[True, np.diff(w[order]) > 0])]
            by = np.argsort(h[lead], kind="stable")
            h, w, o = h[lead][by], w[lead][by], o[lead][by]
            keys, first = np.unique(h, return_index=True)
            self.prefix[k] = (keys, np.r_[first, len(h)], w, o, _filter(keys))


def _filter(keys: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, bool)
    bits[(keys & U64((1 << 20) - 1)).astype(np.int64)] = True
    return bits


def _found(h: np.ndarray, ok: np.ndarray, keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose gram is one of the sorted ``keys``, and which."""
    p = np.flatnonzero(ok & bits[(h & U64((1 << 20) - 1)).astype(np.int64)])
    k = np.searchsorted(keys, h[p])
    k[k == len(keys)] = 0
    hit = keys[k] == h[p] if len(keys) else np.zeros(len(p), bool)
    return p[hit], k[hit]


def _corpus_counts(docs: DataFrame, block: Block) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """How often each of the block's shingles occurs in all documents."""
    keys = {k: np.unique(v[0]) for k, v in block.shingles().items()}
    bits = {k: _filter(v) for k, v in keys.items()}

    def run(batches):
        for batch in slices(batches, "text"):
            w = Words(batch.column("text"), ALNUM)
            for k in keys:
                _, which = _found(*w.grams(k), keys[k], bits[k])
                i, n = np.unique(which, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k), pa.int32()), pa.array(i, pa.int64()), pa.array(n, pa.int64())], names=["k", "i", "n"])

    rows = docs.select("text").mapInArrow(run, "k int, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).collect()  # a row a shingle of the block
    out = {k: (v, np.zeros(len(v), np.int64)) for k, v in keys.items()}
    for r in rows:
        out[r["k"]][1][r["i"]] = r["n"]
    return out


STATE = "n_words long, span_start array<int>, span_end array<int>, items array<string>"


def _scan(docs: DataFrame, block: Block, keep: list[str]) -> DataFrame:
    """Add the block's occurrences to the documents' spans and items."""

    def run(batches):
        for batch in slices(batches, "text"):
            w = Words(batch.column("text"), ALNUM)
            total = len(w.hash)
            starts, wins = [], []
            for k, (keys, first, win, off, bits) in block.prefix.items():
                p, i = _found(*w.grams(k), keys, bits)
                n = first[i + 1] - first[i]
                at = np.repeat(p, n)
                j = np.repeat(first[i], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                s, v = at - off[j], win[j]
                m = block.size[v]
                d = w.doc[at]
                ok = (s >= w.first[d]) & (s + m <= w.first[d + 1])  # place and length bounds
                s, v, m = s[ok], v[ok], m[ok]
                same = np.ones(len(s), bool)
                for x in range(block.words.shape[1]):
                    inside = x < m
                    same &= ~inside | (w.hash[np.minimum(s + x, total - 1)] == block.words[v, x]) if len(s) else same
                starts.append(s[same])
                wins.append(v[same])
            s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
            v = np.concatenate(wins) if wins else np.zeros(0, np.int64)
            cover = np.zeros(total + 1, np.int64)
            np.add.at(cover, s, 1)
            np.add.at(cover, s + block.size[v], -1)
            doc = w.doc[s] if len(s) else np.zeros(0, np.int64)
            old = [batch.column(c).to_pylist() for c in ("span_start", "span_end", "items")]
            for d, (a, b) in enumerate(zip(old[0], old[1], strict=True)):
                for x, y in zip(a, b, strict=True):
                    cover[w.first[d] + x] += 1
                    cover[w.first[d] + y] -= 1
            hit = np.cumsum(cover[:-1]) > 0
            same_doc = np.r_[False, w.doc[1:] == w.doc[:-1]] if total else np.zeros(0, bool)
            begin = np.flatnonzero(hit & ~(np.r_[False, hit[:-1]] & same_doc))
            end = np.flatnonzero(hit & ~(np.r_[hit[1:], False] & np.r_[same_doc[1:], False])) + 1
            spans = np.bincount(w.doc[begin], minlength=batch.num_rows) if len(begin) else np.zeros(batch.num_rows, np.int64)
            base = w.first[w.doc[begin]] if len(begin) else begin
            names = [set(x) for x in old[2]]
            for d, x in {*zip(doc.tolist(), v.tolist(), strict=True)}:
                names[d].update(block.items[x])
            cols = [batch.column(c) for c in keep] + [pa.array(w.count.astype(np.int64)), lists((begin - base).astype(np.int32), spans, pa.int32()), lists((end - base).astype(np.int32), spans, pa.int32()), pa.array([sorted(x) for x in names], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "n_words", "span_start", "span_end", "items"])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string(STATE)]))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_windows: int = BLOCK_WINDOWS, carry: bool = False) -> DataFrame:
    """Every occurrence of every item window in every document.

    Returns doc_id, n_words, span_start and span_end (word numbers of the
    merged hit spans, end exclusive) and items (sorted ids, as strings, of the
    items with an occurring window).  An item of fewer than ``window`` words,
    but not none, is one window.  Null texts have no words; items of null id
    are ignored; documents of null id keep it; repeated rows are reported each;
    an empty benchmark hits nothing; other columns are ignored, or with ``carry``
    all come back in a struct ``row``.
    """
    windows = materialize(item_windows(items, window, item_id, item_text), "windows")
    n = windows.count()
    blocks = max(1, -(-n // block_windows))
    own = ["doc_id", *["row"] * carry]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.struct(*docs.columns).alias("row")] * carry)
    none = F.array().cast("array<int>")
    state = texts.select(*own, "text", F.lit(0).cast("long").alias("n_words"), none.alias("span_start"), none.alias("span_end"), F.array().cast("array<string>").alias("items"))
    for b in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).collect()  # block_windows rows, about
        block = Block(rows, window)
        block.choose(_corpus_counts(texts, block))
        state = _scan(state, block, own if b == blocks - 1 else [*own, "text"])
    release(windows)
    return state


def report(found: DataFrame) -> DataFrame:
    """The contract's columns from ``decontaminate``'s."""
    hit = F.aggregate(F.zip_with("span_start", "span_end", lambda a, b: b - a), F.lit(0).cast("long"), lambda t, x: t + x)
    n = F.size("items")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        n.cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (n >= 2).alias("contaminated"),
    )
