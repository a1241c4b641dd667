"""Best-fit packing: best-fit decreasing over all pieces at once.

Best-fit decreasing looks at lengths only, so it runs on the histogram of
lengths (``capacity`` numbers, whatever the corpus): bins are kept as counts by
remaining capacity, and a segment tree over the capacities finds the tightest
open one in logarithmic time.  Equal lengths are placed in runs.  The plan says
which ranks of which length go where; pieces get their ranks in parallel.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions
from .words import slices

CAPACITY = 2048
#: Bytes of cached words of a worker process, and what an entry takes besides its word and ids.
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 180
#: Bytes of text that are tokenised at once.
TEXT_BYTES = 1 << 20


class OpenBins:
    """Open bins by remaining capacity, with a segment tree of which capacities have any."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves < capacity + 1:
            self.leaves *= 2
        self.any = [False] * (2 * self.leaves)
        self.runs: list[deque] = [deque() for _ in range(capacity + 1)]

    def push(self, room: int, first: int, n: int) -> None:
        """n bins numbered from ``first`` have ``room`` left."""
        self.runs[room].append((first, n))
        self._mark(room)

    def take(self, room: int, n: int) -> tuple[int, int]:
        """At most n bins of that room, as one run of numbers."""
        first, have = self.runs[room].popleft()
        if have > n:
            self.runs[room].appendleft((first + n, have - n))
            have = n
        self._mark(room)
        return first, have

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of an open bin that is at least ``least``."""
        at = self.leaves + least
        if at >= 2 * self.leaves:
            return None
        if self.any[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None

    def _mark(self, room: int) -> None:
        at = self.leaves + room
        self.any[at] = bool(self.runs[room])
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first bin, pieces a bin, offset in the bin), by falling length and rising rank.

    Piece number r of a length, from the run's first rank a on, goes to bin
    ``first + (r - a) // each`` at ``offset + (r - a) % each * length``.  The
    bins and gaps equal those of piece-by-piece best-fit decreasing.
    """
    bins, opened, runs = OpenBins(capacity), 0, []
    for length in sorted((x for x, n in histogram.items() if n > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = bins.tightest(length)
            if room is None:
                room = capacity
                each = room // length
                first, have = opened, -(-left // each)
                opened += have
            else:
                each = room // length
                first, have = bins.take(room, -(-left // each))
            full = min(have, left // each)  # bins that get ``each`` pieces
            if full:
                runs.append((length, rank, first, each, capacity - room))
                bins.push(room - each * length, first, full)
                rank += full * each
                left -= full * each
            if full < have:  # the last bin gets the rest
                runs.append((length, rank, first + full, each, capacity - room))
                if left:
                    bins.push(room - left * length, first + full, 1)
                rank += left
                left = 0
                if have - full > 1:
                    bins.push(room, first + full + 1, have - full - 1)
    return runs


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Text in which the rules below tell the words: ASCII and precomposed Latin-1 letters, no special token.
SIMPLE = re.compile(r"(?!.*<\|)[\t-\r -~À-ÖØ-öø-ÿ]*", re.S)
#: Words of lower-cased simple text: contractions, letters, single digits, runs of other marks.
WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
#: What splits any text without changing its ids: ASCII white space.
CHUNKS = re.compile(r"[^\t-\r ]+")
#: The normaliser and pre-tokeniser for which these rules hold.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _byte_alphabet() -> list[str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Words:
    """Token ids (little-endian bytes) of texts, word by word.

    A lower-casing vocabulary that splits at words encodes each word by itself,
    so only distinct words of simple text are encoded, and they go straight to
    the merge model.  Chunks between white space that are not simple go to the
    tokenizer as they are.  A vocabulary with other rules gets whole texts.  The
    cache has two generations bounded in bytes: when the young one is full the
    old one goes, and words that are still in use come back.
    """

    def __init__(self, coder, cache_bytes: int = CACHE_BYTES):
        self.coder, self.model, self.limit = coder, coder.model, cache_bytes // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0
        # The vocabulary's symbols for the bytes of letters beyond ASCII.
        self.symbols = dict(enumerate(_byte_alphabet()))
        self.by_word = self._rules_hold()

    def _rules_hold(self) -> bool:
        coder = self.coder
        state = lambda part: json.loads(part.__getstate__()) if part is not None else {}
        split, *rest = state(coder.pre_tokenizer).get("pretokenizers", [{}])
        return (
            type(self.model).__name__ == "BPE"
            and state(coder.normalizer) == NORMALIZER
            and split.get("pattern") == {"Regex": SPLITS}
            and (split.get("behavior"), split.get("invert")) == ("Removed", True)
            and [(x.get("type"), x.get("add_prefix_space"), x.get("use_regex")) for x in rest] == [("ByteLevel", False, False)]
            and not coder.truncation
            and all("<|" in x.content for x in coder.get_added_tokens_decoder().values())
        )

    def _ids(self, word: str) -> bytes:
        if SIMPLE.fullmatch(word):
            # Letters and marks in the byte alphabet; ASCII stands for itself.
            word = word if word.isascii() else word.encode().decode("latin-1").translate(self.symbols)
            ids = [t.id for t in self.model.tokenize(word)]
        else:
            ids = self.coder.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _words(self, text: str) -> list[str]:
        if SIMPLE.fullmatch(text):
            return WORDS.findall(text.lower())
        out: list[str] = []
        for chunk in CHUNKS.findall(text):
            if SIMPLE.fullmatch(chunk):
                out += WORDS.findall(chunk.lower())
            else:
                out.append(chunk)
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            coded = (self.coder.encode(t, add_special_tokens=False).ids for t in texts)
            return [struct.pack(f"<{len(x)}I", *x) for x in coded]
        split = [self._words(t) for t in texts]
        known = self.young
        for word in set().union(*split).difference(known):
            ids = self.old.get(word)
            known[word] = ids = self._ids(word) if ids is None else ids
            self.size += len(word) + len(ids) + ENTRY_BYTES
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        if self.size > self.limit:
            self.old, self.young, self.size = known, {}, 0
        return out


#: Of this worker process, by path: a task finds the words of the tasks before it.
_CODERS: dict[str, Words] = {}


def _coder(path: str) -> Words:
    from tokenizers import Tokenizer

    if path not in _CODERS:
        _CODERS[path] = Words(Tokenizer.from_file(path))
    return _CODERS[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text plus ``end_id``, cut every ``capacity`` tokens; see ``Words``.

    Null texts count as empty and give the end id alone; rows of null or repeated
    id are cut each.  Any vocabulary of the tokenizers library will do; the fast
    way is taken only by those whose rules are the ones that it states.
    """

    def run(batches):
        coder = _coder(tokenizer_path)
        tail = np.array([end_id], "<u4").tobytes()
        width = 4 * capacity
        for batch in slices(batches, "text", TEXT_BYTES):
            cols: list[list] = [[], [], [], [], []]
            for key, ids in zip(batch.column(0).to_pylist(), coder.ids([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids += tail
                for p, a in enumerate(range(0, len(ids), width)):
                    part = ids[a : a + width]
                    for c, v in zip(cols, (key, p, a // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (with a ``length`` of 1 to ``capacity``).

    Ranks within a length come from salted windows (length, salt) plus the
    salts' offsets, so a length that most pieces have is not sorted in one
    task.  The broadcast plan has a few runs a length, whatever the corpus.
    Repeated rows are packed each; an empty table gives no rows.
    """
    pieces = materialize(pieces, "pieces")
    spark = pieces.sparkSession
    n = pieces.count()
    salts = max(8, n // 200_000, shuffle_partitions(spark))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    per = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    prior = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("length", "salt", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    runs = np.array(plan(histogram, capacity) or [(1, 0, 0, 1, 0)], np.int64)
    # One number line for all lengths: falling length, then rank.
    starts = np.zeros(capacity + 1, np.int64)
    at = 0
    for length in sorted(histogram, reverse=True):
        starts[length] = at
        at += histogram[length]
    line = starts[runs[:, 0]] + runs[:, 1]

    def place(batches):
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "rank"))
            g = starts[length] + rank
            r = runs[np.searchsorted(line, g, "right") - 1]
            t = rank - r[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(r[:, 2] + t // r[:, 3]), pa.array(r[:, 4] + t % r[:, 3] * length)], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")
    ranked = salted.withColumn("own", F.row_number().over(own) - 1).join(base, ["length", "salt"])
    ranked = ranked.select(*pieces.columns, (F.col("base") + F.col("own")).cast("long").alias("rank"))
    schema = ", ".join(f"`{k}` {t}" for k, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack: one row a piece with its sequence and offset there.

    Null and empty texts are one piece of the end id; only texts of more than
    ``capacity`` tokens are cut; other columns are ignored.
    """
    return pack(token_pieces(docs, tokenizer_path, capacity, id_col=id_col, text_col=text_col), capacity)
