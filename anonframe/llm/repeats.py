"""Substring dedup: sparse suffix trees in prefix partitions.

A window's smallest GRAM-gram hash (the leftmost of equal ones) is the same, at
the same place, wherever the window occurs.  So only suffixes that begin at such
an anchor are shuffled, each with the words around it, and only if the anchor
occurs again.  They are grouped by prefix: the anchor's gram, or, where too many
for a task's memory share it, the longer prefix that is the window itself.  A
group's trees hold the suffixes from each window's first word on, cut off at the
window, since no deeper node tells more about which windows repeat: sorted word
by word, with the common depth of neighbours.  Every leaf below a node as deep
as the window, but the earliest, starts a repeat; consecutive ones are a maximal
repeat, whose span is what is removed.

Equal texts are settled first: all but the first go whole.  Repeats within a
slice of texts are settled there: only the first of equal windows leaves it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, shuffle_partitions
from .words import PLACE_VALUES, PLAIN, U64, Words, lists, mix, signed, slices

WINDOW = 20
GRAM = 8
#: Anchor suffixes of one group at most (about 300 bytes each), and of several groups whose trees are built at once.
TREE_ROWS, CHUNK_ROWS = 1 << 16, 1 << 13


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op (a minimum or maximum) over each ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = op(x[: len(x) - step], x[step:])
        have += step
    return x


def _minima(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, smallest gram hash of each window, is it a window of one document)."""
    n = len(w.hash) - window + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, bool)
    h, _ = w.grams(GRAM)
    return h, _slide(h, window - GRAM + 1, np.minimum), w.doc[:n] == w.doc[window - 1 :]


def _first_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(is the row the first of its text in the batch, by id; number of its text and id, in order of ids)."""
    ids, k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "key", "key2"))
    order = np.lexsort((ids, k2, k1))
    new = np.r_[True, (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])]
    first = np.zeros(len(ids), bool)
    first[order[new]] = True
    by_id = np.lexsort((k2, k1, ids))
    place = np.zeros(len(ids), np.int64)
    place[by_id] = np.arange(len(ids))
    return first, place


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """(kind 0: document, anchors that the slice has several times, anchors that it has once), (kind 1: the former, once a slice)."""

    def run(batches):
        for batch in slices(batches, "text"):
            w = Words(batch.column("text"), PLAIN)
            h, low, ok = _minima(w, window)
            first, _ = _first_rows(batch)
            ok = ok & first[w.doc[: len(ok)]]
            width = window - GRAM + 1
            # A gram is an anchor if it is the minimum of some window over it.
            pad = np.zeros(width - 1, U64)
            best = _slide(np.concatenate([pad, np.where(ok, low, U64(0)), pad]), width, np.maximum)[: len(h)] if len(h) else h
            at = np.flatnonzero(best == h[: len(best)]) if len(h) else np.zeros(0, np.int64)
            u, place, n = np.unique(h[at], return_inverse=True, return_counts=True)
            doc = w.doc[at]
            cols = []
            for part in (n[place] > 1, n[place] == 1):
                cols.append(lists(signed(h[at][part]), np.r_[np.bincount(doc[part], minlength=batch.num_rows), 0], pa.int64()))
            often = u[n > 1]
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * k + [1], pa.int32()), *(pa.concat_arrays([batch.column(c), pa.nulls(1, pa.int64())]) for c in ("id", "key", "key2")), *cols, lists(signed(often), np.array([0] * k + [len(often)]), pa.int64())],
                names=["kind", "id", "key", "key2", "several", "once", "here"],
            )

    return docs.mapInArrow(run, "kind int, id long, key long, key2 long, several array<long>, once array<long>, here array<long>")


def _suffixes(docs: DataFrame, window: int) -> DataFrame:
    """(id, key, at, gram, mask, words): suffixes from anchors on, with the words around them and, as bits, how far before them a window begins that may repeat; mask is null where the window from ``at`` on equals an earlier one of the slice."""
    before = window - GRAM

    def run(batches):
        for batch in slices(batches, "text"):
            w = Words(batch.column("text"), PLAIN)
            h, low, ok = _minima(w, window)
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "key"))
            first, place = _first_rows(batch)  # rows that repeat an id and its text are one document
            known = np.unique(batch.column("anchors").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U64))
            s = np.zeros(0, np.int64)
            if len(low) and len(known):
                k = np.minimum(np.searchsorted(known, low), len(known) - 1)
                s = np.flatnonzero(ok & (known[k] == low) & first[w.doc[: len(low)]])
            if not len(s):
                continue
            doc = w.doc[s]
            p, q = h[s], np.zeros(len(s), U64)
            for j in range(GRAM, window):
                q += w.hash[s + j] * PLACE_VALUES[j]
            order = np.lexsort((s, place[doc], q, p))
            lead = np.ones(len(s), bool)
            lead[order[1:]] = (p[order][1:] != p[order][:-1]) | (q[order][1:] != q[order][:-1])
            far = s[~lead]
            s = s[lead]
            ahead = np.concatenate([h[s[i : i + 65536, None] + np.arange(before + 1)].argmin(axis=1) for i in range(0, len(s), 65536)])
            at, which = np.unique(s + ahead, return_inverse=True)
            mask = np.zeros(len(at), np.int32)
            np.bitwise_or.at(mask, which, (1 << ahead).astype(np.int32))
            raw = np.ascontiguousarray(w.hash[np.clip(at[:, None] + np.arange(-before, window), 0, len(w.hash) - 1)])
            words = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * (before + window)), len(raw), [None, pa.py_buffer(raw)]).cast(pa.binary())
            names = ["id", "key", "at", "gram", "mask", "words"]
            for x, cols in ((at, [pa.array(signed(h[at])), pa.array(mask), words]), (far, [pa.nulls(len(far), t) for t in (pa.int64(), pa.int32(), pa.binary())])):
                d = w.doc[x]
                yield pa.RecordBatch.from_arrays([pa.array(ids[d], pa.int64()), pa.array(keys[d], pa.int64()), pa.array((x - w.first[d]).astype(np.int32)), *cols], names=names)

    return docs.mapInArrow(run, "id long, key long, at int, gram long, mask int, words binary")


def _windows(t: pa.Table, window: int) -> tuple[np.ndarray, ...]:
    """(words[window, word], id, key, start) of the windows that ``_suffixes`` rows stand for."""
    before = window - GRAM
    words = t.column("words").combine_chunks()
    words = words if isinstance(words, pa.Array) else pa.concat_arrays(words.chunks)
    near = np.frombuffer(b"".join(words.to_pylist()), U64).reshape(-1, before + window)
    ids, keys, at, mask = (t.column(c).to_numpy() for c in ("id", "key", "at", "mask"))
    row, ahead = np.nonzero(mask[:, None] >> np.arange(before + 1) & 1)
    return near[row[:, None], (before - ahead)[:, None] + np.arange(window)], ids[row], keys[row], (at[row] - ahead).astype(np.int32)


def _deep_leaves(suffixes: DataFrame, window: int, n: int) -> DataFrame:
    """(id, key, start) of every leaf but the earliest below each node of full depth, group by group."""
    chunk = CHUNK_ROWS

    def leaves(t: pa.Table) -> pa.RecordBatch:
        w, ids, keys, start = _windows(t, window)
        # The trees' suffix arrays: equal words sort by document and place.
        order = np.lexsort((start, keys, ids, *(w[:, j] for j in range(window - 1, -1, -1))))
        w, ids, keys, start = w[order], ids[order], keys[order], start[order]
        same = w[1:] == w[:-1]
        depth = np.where(same.all(axis=1), window, same.argmin(axis=1))  # the common depth with the leaf before
        node = np.r_[True, depth < window]
        leaf = np.r_[True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (start[1:] != start[:-1])]
        rank = np.cumsum(leaf)
        first = np.maximum.accumulate(np.where(node, np.arange(len(w)), 0))
        far = rank > rank[first]
        return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(keys[far]), pa.array(start[far])], names=["id", "key", "start"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= chunk:
                t = pa.Table.from_batches(held)
                gram = t.column("gram").to_numpy()
                new = np.flatnonzero(gram[1:] != gram[:-1])
                if len(new):  # the last group may go on
                    yield leaves(t.slice(0, int(new[-1]) + 1))
                    t = t.slice(int(new[-1]) + 1)
                held, rows = t.combine_chunks().to_batches(), len(t)
        if rows:
            yield leaves(pa.Table.from_batches(held))

    return suffixes.repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(run, "id long, key long, start int")


def _hot_leaves(suffixes: DataFrame, window: int) -> DataFrame:
    """The same for groups that no task could hold: their windows are the prefixes, each with its earliest leaf."""

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                w, ids, keys, start = _windows(pa.Table.from_batches([b.slice(a, 4096)]), window)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in w], pa.binary()), pa.array(ids), pa.array(keys), pa.array(start)], names=["words", "id", "key", "start"])

    whole = suffixes.mapInArrow(run, "words binary, id long, key long, start int")
    leaf = F.struct("id", "key", "start")
    first = whole.groupBy("words").agg(F.min(leaf).alias("first"))
    return whole.join(first, "words").where(leaf != F.col("first")).select("id", "key", "start")


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word that a window covers whose words also start earlier.

    Earlier means a smaller id, or an earlier start in the same document.
    Returns doc_id, n_words, n_removed, span_start and span_end (word numbers
    of the removed spans, end exclusive) and kept_text (kept words joined by one
    space).  Words are split at ASCII white space, not folded, and compared by
    64-bit hashes.  Null and empty texts have no words; very long texts are read
    whole; rows of null id are kept whole and remove nothing; rows that repeat an
    id and its text are one document and are reported each; texts that share an
    id are documents of their own, in order of a hash; an empty table gives no
    rows; other columns are ignored.
    """
    n = shuffle_partitions(docs.sparkSession)
    text = F.col(text_col).cast("string")
    own = ["id", "key", "key2"]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), text).alias("key2"), text.alias("text"))
    known = texts.where("id IS NOT NULL")
    anchors = materialize(_anchors(known, window), "anchors")
    every = anchors.where("kind = 0")
    # Of equal texts (128 bits of hashes) the smallest id goes on.
    lead = materialize(every.groupBy("key", "key2").agg(F.min("id").alias("id"), F.max("id").alias("last")), "leads")
    ahead = every.join(lead.select(*own), own, "left_semi")
    once = ahead.select("key", F.explode("once").alias("h"))
    here = anchors.where("kind = 1").select(F.explode("here").alias("h"))
    often = once.select("h").unionByName(here).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = ahead.select("key", F.explode("several").alias("h"))
    hits = once.join(often.select("h"), "h").select("key", "h").unionByName(several)
    hits = hits.groupBy("key").agg(F.collect_set("h").alias("anchors")).join(lead.select(*own), "key")
    hits = materialize(hits, "hits")
    copies = every.select(*own).distinct().join(lead.where("last > id").select("key", "key2", F.col("id").alias("first")), ["key", "key2"]).where("id > first")
    copies = materialize(copies.select(*own), "copies")
    release(anchors, lead)
    marked = materialize(_suffixes(known.join(hits, own), window), "suffixes")
    release(hits)
    trees = marked.where("mask IS NOT NULL")
    hot = materialize(trees.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > TREE_ROWS).select("gram"), "hot")  # a row for TREE_ROWS suffixes at most
    found = marked.where("mask IS NULL").select("id", "key", F.col("at").alias("start"))
    if hot.isEmpty():
        found = found.unionByName(_deep_leaves(trees, window, n))
    else:
        found = found.unionByName(_deep_leaves(trees.join(hot, "gram", "left_anti"), window, n)).unionByName(_hot_leaves(trees.join(hot, "gram", "left_semi"), window))
    starts = found.groupBy("id", "key").agg(F.collect_set("start").alias("starts")).withColumn("copy", F.lit(False))
    starts = starts.unionByName(copies.select("id", "key", F.array().cast("array<int>").alias("starts"), F.lit(True).alias("copy")))
    starts = materialize(starts, "starts")
    release(marked, hot, copies)

    def cut(batches):
        for batch in slices(batches, "text"):
            cols: list[list] = [[], [], [], [], []]
            for text, s, copy in zip(batch.column("text"), batch.column("starts"), batch.column("copy").to_pylist(), strict=True):
                words = (text.as_py() or "").encode().split()
                cover = np.zeros(len(words) + 1, np.int64)
                if s.is_valid and len(s.values):
                    a = s.values.to_numpy()
                    a = a[a + window <= len(words)]
                    np.add.at(cover, a, 1)
                    np.add.at(cover, a + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                if copy and len(words) >= window:  # every window starts earlier, in the first of the equal texts
                    gone[:] = True
                edge = np.diff(np.r_[0, gone.astype(np.int8), 0])
                begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                kept, at = [], 0
                for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                for c, v in zip(cols, (len(words), int(gone.sum()), begin.astype(np.int32), end.astype(np.int32), b" ".join(kept).decode()), strict=True):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_words", "n_removed", "span_start", "span_end", "kept_text"])

    return texts.join(starts, ["id", "key"], "left").mapInArrow(cut, "doc_id long, n_words long, n_removed long, span_start array<int>, span_end array<int>, kept_text string")


def report(removed: DataFrame) -> DataFrame:
    """The contract's columns from ``remove_repeats``'s."""
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
