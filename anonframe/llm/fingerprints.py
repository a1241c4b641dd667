"""Document fingerprints: winnowing in native column expressions.

Rolling (cyclic polynomial) hashes of k tokens; from each window of hashes the
smallest is kept, the rightmost of equal ones, with its position.  Two texts
that share ``window + k - 1`` tokens in a row share a fingerprint entry.  A token
is a run of up to 24 characters without white space, or one character of a
script that is written without spaces; runs also break where ordinary scripts
meet rarer characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3
WINDOW = 8
#: Low bits of a packed entry hold the position, counted down, so that the minimum is the rightmost.
POSITION_BITS = 24
#: Code points of scripts that are written without spaces.
UNSPACED_RANGES = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
UNSPACED = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in UNSPACED_RANGES)
#: One range takes nearly all text; the rest of Unicode comes after.
COMMON = "!-\\x{DFF}"
TOKEN = f"[{COMMON}]{{1,24}}+|[{UNSPACED}]|[^\\s{COMMON}{UNSPACED}]{{1,24}}+"
#: Documents whose order is settled together, see ``with_next``, and buckets at most; on more documents than their product buckets grow, and sort on disk.
BUCKET_DOCS = 2000
MAX_BUCKETS = 1 << 15


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _part(x: Column, skip: int, short: int) -> Column:
    """x[skip:], less the last ``short - skip`` items."""
    return F.slice(x, F.lit(1 + skip), F.greatest(F.size(x) - short, F.lit(0)))


def _rotate(h: Column, bits: int) -> Column:
    return F.shiftleft(h, bits).bitwiseOR(F.shiftrightunsigned(h, 64 - bits))


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """Sorted-by-position array of packed entries of a text (null: empty).

    An entry is a 40-bit hash above ``POSITION_BITS`` bits of position.  A text of
    fewer than k tokens, but not none, has one entry for all of them.
    """
    low = (1 << POSITION_BITS) - 1
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))

    def grams(h: Column) -> Column:
        out = h
        for j in range(1, k):
            # The sum so far, turned by one bit, and the next token's hash.
            out = F.zip_with(_part(out, 0, 1) if j == 1 else F.slice(out, F.lit(1), F.greatest(F.size(h) - j, F.lit(0))), _part(h, j, j), lambda a, b: _rotate(a, 1).bitwiseXOR(b))
        short = F.array(F.xxhash64(h))
        return F.when(F.size(h) >= k, out).when(F.size(h) > 0, short).otherwise(F.array().cast("array<long>"))

    def packed(h: Column) -> Column:
        return F.transform(h, lambda x, i: F.shiftleft(F.xxhash64(x), POSITION_BITS).bitwiseOR(F.lit(low).cast("long").bitwiseXOR(i.cast("long").bitwiseAND(F.lit(low)))))

    def slide(step: int):
        # A text of fewer hashes is one window.
        return lambda y: F.when(F.size(y) > step, F.zip_with(_part(y, 0, step), _part(y, step, step), lambda a, b: F.least(a, b))).when(F.size(y) > 0, F.array(F.array_min(y))).otherwise(y)

    def minima(x: Column) -> Column:
        have = 1
        while have < window:
            step = min(have, window - have)
            x = _let(x, slide(step))
            have += step
        return F.array_distinct(x)

    hashes = F.transform(tokens, lambda t: F.xxhash64(t))
    return _let(_let(hashes, grams), lambda g: minima(packed(g)))


def entries(packed: Column) -> Column:
    """array<struct<hash, position>> of a packed fingerprint."""
    low = (1 << POSITION_BITS) - 1
    return F.transform(packed, lambda x: F.struct(F.shiftright(x, POSITION_BITS).alias("hash"), F.lit(low).cast("long").bitwiseXOR(x.bitwiseAND(F.lit(low).cast("long"))).alias("position")))


def as_text(packed: Column) -> Column:
    return packed.cast("string")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two packed fingerprints' hashes; two empty ones are alike."""
    x, y = (F.array_distinct(F.transform(p, lambda v: F.shiftright(v, POSITION_BITS))) for p in (a, b))
    return _let(F.struct(x.alias("x"), y.alias("y")), lambda s: _let(F.size(F.array_intersect(s["x"], s["y"])), lambda n: F.when((F.size(s["x"]) == 0) & (F.size(s["y"]) == 0), F.lit(1.0)).otherwise(n / F.greatest(F.size(s["x"]) + F.size(s["y"]) - n, F.lit(1)))))


def with_next(docs: DataFrame, cols: list[str], key: str = "__key") -> DataFrame:
    """Add next_<col> of the row with the next larger key; the last row's next is the first.

    Boundaries drawn from the keys cut the order into buckets.  The rows at a
    boundary also visit the bucket before, as donors, so one exchange and a
    window per bucket settle the order.  Equal keys follow by a hash of their
    columns.
    """
    keys = docs.select(key)
    total = keys.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo")).first()
    if not total["n"]:
        return docs.select("*", *(F.col(c).alias(f"next_{c}") for c in cols))
    buckets = max(1, min(MAX_BUCKETS, total["n"] // BUCKET_DOCS))
    bounds = {total["lo"]}
    if buckets > 1:
        every = max(1, total["n"] // (buckets * 8))
        drawn = sorted(r[0] for r in keys.where(F.pmod(F.xxhash64(key, F.lit(3)), F.lit(every)) == 0).select(key).distinct().collect())  # about 8 a bucket
        bounds |= {drawn[len(drawn) * j // buckets] for j in range(1, buckets) if drawn}
    bounds = sorted(bounds)
    n, step, steps = len(bounds), 1, []
    while step <= n:
        steps.insert(0, step)
        step *= 2
    edge = F.lit(bounds)
    at = F.aggregate(F.lit(steps), F.lit(0), lambda p, s: F.when((p + s <= n) & (F.try_element_at(edge, p + s) <= F.col(key)), p + s).otherwise(p))
    rows = docs.withColumn("__b", at)  # 1 to n
    first = F.element_at(edge, F.col("__b")) == F.col(key)
    before = F.when(F.col("__b") == 1, F.lit(n)).otherwise(F.col("__b") - 1)
    own = F.struct(F.col("__b").alias("b"), F.lit(0).alias("donor"))
    visits = F.when(first, F.array(own, F.struct(before.alias("b"), F.lit(1).alias("donor")))).otherwise(F.array(own))
    rows = rows.withColumn("__v", F.explode(visits)).select("*", "__v.b", "__v.donor").drop("__v", "__b")
    w = Window.partitionBy("b").orderBy("donor", key, "__tie")
    rows = rows.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in cols))
    return rows.where("donor = 0").drop("b", "donor")


def fingerprint_documents(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text has its last floor(n/2) code points replaced by the first as
    many (or all) of the next document, by ascending id; after the last comes
    the first.  Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint (packed entries), near_edited, near_next
    and entries.  Null texts are empty; a null id comes before all others; rows
    of one id follow each other by a hash of their text; a lone row is its own
    next; an empty table gives no rows; other columns are ignored.  Of equal
    hashes in a window the rightmost counts.  Very long texts are read whole;
    positions in ``entries`` are modulo 2^24 tokens, their hashes are not.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("__key"))
    rows = rows.withColumn("__tie", F.xxhash64("text")).withColumn("fp", fingerprint(F.col("text"), k, window))
    rows = with_next(rows, ["text", "fp"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.withColumn("edited_fp", fingerprint(F.col("edited"), k, window))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        entries(F.col("fp")).alias("entries"),
    )
