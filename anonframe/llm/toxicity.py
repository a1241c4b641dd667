"""Toxicity: a lexicon trie met by a Levenshtein automaton, and context windows.

The lexicon is learned from labelled rows: whole terms and word stems that mark
the label.  A word runs through the trie and the edit automaton together (their
product is determinised as words need it), so misspelled terms are caught; each
hit counts by the words around it, which tell a quotation from abuse.  A small
logistic model turns the counts into a score.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .words import slices

#: Labelled rows that the lexicon and the model are fitted on, at most; it bounds the fit, not the scoring.
FIT_ROWS = 8192
STEMS = (3, 4, 5, 6, 7, 8)
#: A term of at least so many letters may have so many edits.
EDITS = ((10, 2), (5, 1), (0, 0))
#: Words on each side of a hit that are its context.
CONTEXT = 6
CACHE_WORDS = 400_000
#: States of the determinised automaton that are kept; beyond them it is determinised anew.
MAX_STATES = 100_000
#: Words that introduce somebody else's speech.
REPORTING = frozenset("said says say wrote writes called calls quoted quote quotes quoting reported reports claimed told citation cited dijo dice escribió citó dit écrit cité sagte schrieb zitiert".split())
QUOTES = "\"“”„«»‘’"
WORD = re.compile(r"[^\W\d_]+")
FEATURES = ("exact", "exact_quoted", "fuzzy", "fuzzy_quoted", "stem", "stem_quoted", "weak", "weak_quoted", "dense")


class Lexicon:
    """Terms (whole words, with edits where allowed) and stems (word beginnings)."""

    def __init__(self, terms: list[str], stems: list[str], rigid: set[str] = frozenset(), weak: list[str] = ()):
        self.terms, self.stems, self.rigid, self.weak = terms, stems, rigid, frozenset(weak)
        stems = [*stems, *(w for w in weak if w not in stems)]
        self.child: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.budget = [0]  # most edits of a term at or below the node
        for words, ends in ((terms, self.term), (stems, self.stem)):
            for word in words:
                at = 0
                k = 0 if words is stems else self.edits(word)
                self.budget[0] = max(self.budget[0], k)
                for ch in word:
                    nxt = self.child[at].get(ch)
                    if nxt is None:
                        nxt = self.child[at][ch] = len(self.child)
                        self.child.append({})
                        self.term.append(None)
                        self.stem.append(None)
                        self.budget.append(0)
                    at = nxt
                    self.budget[at] = max(self.budget[at], k)
                ends[at] = word
        self._forget()

    def _forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.found: list[tuple | None] = []
        self.begin = self._state({(0, 0)})

    def edits(self, term: str) -> int:
        return 0 if term in self.rigid else next(k for n, k in EDITS if len(term) >= n)

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """The automaton's state for trie nodes with edits used; skipping letters of a term costs edits too."""
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if e < self.budget[node]:
                for c in self.child[node].values():
                    if e + 1 <= self.budget[c] and (c, e + 1) not in pairs:
                        pairs.add((c, e + 1))
                        todo.append((c, e + 1))
        key = frozenset(pairs)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            hits = [(e, self.term[n]) for n, e in key if self.term[n] and e <= self.edits(self.term[n])]
            self.found.append(min(hits) if hits else None)
        return self.states[key]

    def _step(self, state: int, ch: str) -> int:
        pairs = set()
        for node, e in self.sets[state]:
            if (c := self.child[node].get(ch)) is not None:
                pairs.add((c, e))
            if e < self.budget[node]:
                pairs.add((node, e + 1))
                pairs |= {(c, e + 1) for c in self.child[node].values() if e + 1 <= self.budget[c]}
        to = self._state(pairs) if pairs else -1
        self.next[state][ch] = to
        return to

    def match(self, word: str) -> tuple[str, str] | None:
        """('exact' | 'stem' | 'weak' | 'fuzzy', term) of a folded word; weak is a stem that clean texts have too."""
        if len(self.sets) > MAX_STATES:
            self._forget()
        at, stem, node = self.begin, None, 0
        for ch in word:
            if node is not None:
                node = self.child[node].get(ch)
                if node is not None and self.stem[node] and (stem is None or stem in self.weak):
                    stem = self.stem[node]
            if at >= 0:
                to = self.next[at].get(ch)
                at = self._step(at, ch) if to is None else to
            if at < 0 and node is None:
                break
        hit = self.found[at] if at >= 0 else None
        if hit and hit[0] == 0:
            return "exact", hit[1]
        if stem:
            return "weak" if stem in self.weak else "stem", stem
        return ("fuzzy", hit[1]) if hit else None


def _quoted(text: str, a: int, b: int) -> bool:
    """Is text[a:b] between quotation marks, or introduced as speech, within its context window?"""
    left, right = text[max(0, a - 12 * CONTEXT) : a], text[b : b + 12 * CONTEXT]
    marks = sum(c in QUOTES for c in left) % 2 == 1 and any(c in QUOTES for c in right)
    return marks or bool(REPORTING.intersection(WORD.findall(left)[-CONTEXT:]))


def features(text: str, lexicon: Lexicon, known: dict) -> tuple[list[float], list[tuple[str, str, str, bool]]]:
    """The model's features of a text, and its hits (word, kind, term, quoted)."""
    text = text.lower()
    words = WORD.findall(text)
    distinct = set(words)
    new = [w for w in distinct if w not in known]
    if len(known) + len(new) > CACHE_WORDS:
        known.clear()
        new = distinct
    for w in new:
        known[w] = lexicon.match(w)
    out = dict.fromkeys(FEATURES, 0.0)
    hits = []
    if any(known[w] for w in distinct):
        for m in WORD.finditer(text):
            if kind := known[m.group()]:
                quoted = _quoted(text, m.start(), m.end())
                hits.append((m.group(), *kind, quoted))
                out[kind[0] + "_quoted" * quoted] += 1
        out["dense"] = sum(not h[3] for h in hits) / math.sqrt(len(words))
    return [math.log1p(out[k]) for k in FEATURES], hits


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray, bias: float):
        self.lexicon, self.weights, self.bias = lexicon, weights, bias

    def score(self, x: list[float]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + float(np.dot(self.weights, x))))))


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(id, text, y) of at most ``fit_rows`` labelled ids, drawn by a hash of the id; of an id with several texts the first in order."""
    drawn = labels.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(fit_rows)
    rows = docs.join(F.broadcast(drawn), "id").where("text IS NOT NULL")  # fit_rows rows of 12 bytes
    return rows.groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y"))


def _marks(sample: DataFrame):
    """(word or stem with a dash, ids with label 1) of all marks that a few label-1 rows have and hardly any others."""
    words = F.array_distinct(F.split(F.lower("text"), "[^\\p{L}]+"))
    stems = F.flatten(F.transform("w", lambda w: F.transform(F.filter(F.lit(list(STEMS)), lambda k: F.length(w) > k), lambda k: F.concat(F.substring(w, F.lit(1), k), F.lit("-")))))
    rows = sample.withColumn("w", words).select("id", "y", F.explode(F.array_distinct(F.concat("w", stems))).alias("mark")).where("mark <> ''")
    per = rows.groupBy("mark").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"), F.collect_list(F.when(F.col("y") == 1, F.col("id"))).alias("ids"))
    return per.where("n1 >= 3 AND n0 <= n1")


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on docs (id, text) and labels (id, y)."""
    sample = materialize(_sample(docs, labels, fit_rows), "labelled")
    rows = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = rows.get(0, 0), rows.get(1, 0)
    base = (n1 + 1) / (n0 + n1 + 2)
    prior = math.log(base / (1 - base))
    empty = Model(Lexicon([], []), np.zeros(len(FEATURES)), prior)
    if not n1 or not n0:
        return empty
    marks = [(r["mark"], r["n1"], r["n0"], frozenset(r["ids"])) for r in _marks(sample).orderBy(F.desc("n1"), "n0", "mark").collect()]  # of fit_rows texts
    terms, stems, weak = _choose(marks, base)
    lexicon = Lexicon(terms, stems, weak=weak)

    def run(lex):
        def go(batches):
            known: dict = {}
            for batch in slices(batches, "text"):
                got = [features(t or "", lex, known) for t in batch.column("text").to_pylist()]
                fuzzy = [sorted({h[2] for h in g[1] if h[1] == "fuzzy"}) for g in got]
                yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([g[0] for g in got], pa.list_(pa.float64())), pa.array(fuzzy, pa.list_(pa.string()))], names=["y", "x", "fuzzy"])

        return sample.mapInArrow(go, f"y {sample.schema['y'].dataType.simpleString()}, x array<double>, fuzzy array<string>").collect()  # fit_rows rows

    got = run(lexicon)
    seen: dict = defaultdict(lambda: [0, 0])
    for r in got:
        for t in r["fuzzy"]:
            seen[t][r["y"]] += 1
    # A term whose near misses are ordinary words is matched as it is spelled.
    rigid = {t for t, (a, b) in seen.items() if a > 0.02 * b or a > 0.002 * n0}
    if rigid:
        lexicon = Lexicon(terms, stems, rigid, weak)
        got = run(lexicon)
    x = np.array([r["x"] for r in got]).reshape(-1, len(FEATURES))
    y = np.array([r["y"] for r in got], float)
    return Model(lexicon, *_logistic(x, y))


def _choose(marks: list, base: float) -> tuple[list[str], list[str], list[str]]:
    """Terms, stems and weak stems: first a cover of the labelled rows by the most significant marks, then all marks too pure for chance."""
    odds, many = math.log(base), math.log(max(len(marks), 2) * 50.0)
    loose = [m for m in marks if m[0].endswith("-") and m[2] > 0 and m[1] >= 8 and m[1] >= 4 * base * (m[1] + m[2])]
    marks = [m for m in marks if m[2] <= 0.2 * m[1]]
    chosen: dict[str, None] = {}
    left = set().union(*(m[3] for m in marks)) if marks else set()
    rest = list(marks)
    while rest and left:
        best = max(rest, key=lambda m: (len(m[3] & left) - 3 * m[2], m[1], not m[0].endswith("-"), len(m[0])))
        new = len(best[3] & left)
        if (new - 3 * best[2]) * odds + many > math.log(0.05):
            break
        chosen[best[0]] = None
        left -= best[3]
        rest.remove(best)
    for name, n1, n0, _ in marks:
        if (n1 - 3 * n0) * odds + many < math.log(1e-4):
            chosen[name] = None
    terms = [m for m in chosen if not m.endswith("-")]
    stems = [m[:-1] for m in chosen if m.endswith("-")]
    # A stem of a chosen term adds only what no label spoke for.
    stems = [s for s in stems if not any(t.startswith(s) for t in terms)]
    weak = [m[0][:-1] for m in loose if m[0] not in chosen]
    return sorted(terms), sorted(stems), sorted(s for s in weak if not any(t.startswith(s) for t in terms if len(t) <= len(s) + 2))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps, with non-negative weights: a hit never speaks for a clean text."""
    scale = np.maximum(x.max(axis=0), 1e-9)
    a = np.c_[x / scale, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + penalty * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        w[:-1] = np.maximum(w[:-1], 0)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1] / scale, float(w[-1])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, score (0 to 1) and hits array<struct<word, kind, term, quoted>> of every whole text.

    Null and empty texts score as texts without hits; ids may be null and rows
    may repeat; other columns are ignored, or with ``carry`` all come back in a
    struct ``row``.
    """
    own = ["id", *["row"] * carry]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *[F.struct(*docs.columns).alias("row")] * carry)
    kind = pa.list_(pa.struct([("word", pa.string()), ("kind", pa.string()), ("term", pa.string()), ("quoted", pa.bool_())]))

    def run(batches):
        known: dict = {}
        for batch in slices(batches, "text"):
            scores, hits = [], []
            for t in batch.column("text"):
                x, h = features(t.as_py() or "", model.lexicon, known)
                scores.append(model.score(x))
                hits.append([dict(zip(("word", "kind", "term", "quoted"), v, strict=True)) for v in h])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(scores, pa.float64()), pa.array(hits, kind)], names=[*own, "score", "hits"])

    out = T._parse_datatype_string("score double, hits array<struct<word: string, kind: string, term: string, quoted: boolean>>")
    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in own), *out])).withColumnRenamed("id", "doc_id")


def detect(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held: int = 0, fit_rows: int = FIT_ROWS, carry: bool = False) -> DataFrame:
    """Fit on labelled rows whose crc32(id as text) mod ``folds`` is not ``held``; score all rows.

    Returns doc_id, held_out, score, predicted and hits.  Without usable labels
    the score is the prior of one half.  Null labels and null ids are not
    learned from; a null id is not held out.  Null and empty texts score as texts
    without hits, very long ones are scored whole; rows that repeat an id are
    scored each, and learned from once; of an id with several labels 1 counts; a
    score of exactly 0.5 is predicted 1; an empty table gives no rows.
    """
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold != held)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    model = learn(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), known, fit_rows)
    out = score(docs, model, id_col, text_col, carry)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits", *["row"] * carry)
