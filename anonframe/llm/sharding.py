"""Sharding: sampled splitters over (text key, id), native DataFrame code only.

Size-weighted key samples give quantile boundaries; rows are range-partitioned
by them, ranges that came out overfull are subdivided by further samples, and
exact byte sums of the ranges place every row.  Equal texts have one key and
stay together.  Groups of them (often one long text) that are large against a
shard, a bounded number, are dealt out first, each whole to the emptiest shard;
the ranges fill what is left.  Only a group of more than a shard is cut.  Texts
are never shuffled: after the scan a row is its id, its size and two hashes.
"""

from __future__ import annotations

from itertools import count as turns

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows that one range is meant to hold at most; ranges are sorted one by one.
RANGE_ROWS = 250_000
#: Sampled keys for each range.
OVERSAMPLE = 16
#: A range is overfull beyond this many times the mean bytes of a range.
OVERFULL = 2.0
#: A group of equal texts is large beyond this part of a shard; there are at most shards * LARGE such groups.
LARGE = 20


def _range_of(bounds: list[tuple[int, int]]):
    """Number of boundaries at or below (key, id): a binary search over literals."""
    if not bounds:
        return F.lit(0)
    keys, ids = F.lit([b[0] for b in bounds]), F.lit([b[1] for b in bounds])
    n, step, steps = len(bounds), 1, []
    while step <= n:
        steps.insert(0, step)
        step *= 2

    def go(at, s):
        to = at + s
        k, i = F.try_element_at(keys, to), F.try_element_at(ids, to)
        below = (k < F.col("key")) | ((k == F.col("key")) & (i <= F.col("__id")))
        return F.when((to <= n) & below, to).otherwise(at)

    return F.aggregate(F.lit(steps), F.lit(0), go)


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` shards of near equal bytes.

    Returns ``id_col``, size (UTF-8 bytes plus 1), text_crc32, law ('bytes'),
    shard, slot (from 0 without gaps in each shard) and grown_shard (null:
    under this law a further shard moves other rows too).  Rows are ordered by
    a hash of the text, then id, so equal texts are neighbours and share a shard;
    a group of them that no shard has room for (more bytes than a shard, that
    is, or one of several that nearly fill one) is cut at shard boundaries.
    Null texts count as empty; null ids sort as the smallest id; repeated rows
    each get a slot; a text of more than a shard's bytes is a shard's only
    group; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("__id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    rows = materialize(rows, "shard-rows")
    total = rows.agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).first()
    total_bytes, count = total["s"] or 0, total["n"]
    ranges = max(shards * 4, -(-count // RANGE_ROWS))
    target = max(1.0, total_bytes / shards)
    large = rows.groupBy("key").agg(F.sum("size").alias("g"), F.count(F.lit(1)).alias("n")).where(F.col("g") > F.lit(target / LARGE)).collect()  # at most shards * LARGE groups
    hot = {r["key"] for r in large}
    bounds: list[tuple[int, int]] = []
    drawn = F.pmod(F.xxhash64("key", "__id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    if total_bytes:
        # The chance of a draw is the row's share of the bytes times the draws, so the sample is of a fixed expected size.
        sample = rows.where(drawn < F.col("size") * F.lit(ranges * OVERSAMPLE / total_bytes)).select("key", "__id", "size")
        bounds = _quantiles(sample.collect(), ranges, total_bytes / (ranges * OVERSAMPLE), hot)
        bounds = _subdivide(rows, bounds, total_bytes / ranges, drawn, hot)

    placed = rows.withColumn("range", _range_of(bounds))
    room, homes = [target] * shards, []
    for r in sorted(large, key=lambda r: (-r["g"], r["key"])):
        to = max(range(shards), key=lambda k: (room[k], -k))
        if r["g"] <= room[to] or r["n"] == 1:
            room[to] -= r["g"]
            homes.append((r["key"], to))
    whole = {k for k, _ in homes}
    cut = [r["key"] for r in large if r["key"] not in whole]
    homes = placed.sparkSession.createDataFrame(homes, "key long, home int")
    edges, run = [], 0.0
    for x in room[:-1]:
        run += max(0.0, x)
        edges.append(run)
    edges = F.lit(edges) if edges else F.array().cast("array<double>")

    w = Window.partitionBy("range").orderBy("key", "__id", "doc_id", "text_crc32", "size")
    group = Window.partitionBy("range", "key")
    small = F.when(F.col("home").isNull(), F.col("size")).otherwise(F.lit(0))
    ordered = placed.join(F.broadcast(homes), "key", "left")
    sums = ordered.groupBy("range").agg(F.sum(small).alias("bytes")).collect()  # a row a range
    at, offsets = 0, [0] * (len(bounds) + 1)
    for r in sorted(sums, key=lambda r: r["range"]):
        offsets[r["range"]] = at
        at += r["bytes"]
    before = F.element_at(F.lit(offsets), F.col("range") + 1) + F.sum(small).over(w.rowsBetween(Window.unboundedPreceding, 0)) - small
    ordered = ordered.withColumn("small", small).withColumn("before", before)
    ordered = ordered.withColumn("g", F.sum("small").over(group)).withColumn("g0", F.min("before").over(group))
    by_row = F.col("key").isin(cut) if cut else F.lit(False)
    middle = F.when(by_row, F.col("before") + F.col("small") / 2).otherwise(F.col("g0") + F.col("g") / 2)
    shard = F.coalesce(F.col("home"), F.size(F.filter(edges, lambda e: e <= F.col("middle"))))
    ordered = ordered.withColumn("middle", middle.cast("double")).select("doc_id", "size", "text_crc32", "range", "key", "__id", shard.cast("int").alias("shard"))
    ordered = materialize(ordered, "shard-placed")
    # Slots: rows of the same shard in lower ranges, then the place within the range.
    per = ordered.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    prior = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("shard", "range", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("base"))
    own = Window.partitionBy("shard", "range").orderBy("key", "__id", "doc_id", "text_crc32", "size")
    out = ordered.withColumn("own", F.row_number().over(own) - 1).join(per, ["shard", "range"])
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.col("own")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _snapped(bounds, hot: set) -> list[tuple[int, int]]:
    """Only a large group may be cut: other boundaries move to their key's first row."""
    return sorted({(k, i if k in hot else -(1 << 63)) for k, i in bounds})


def _quantiles(sample: list, ranges: int, weight: float, hot: set) -> list[tuple[int, int]]:
    """Boundaries at equal steps of sampled weight."""
    rows = sorted((r["key"], r["__id"], max(weight, r["size"])) for r in sample)
    whole = sum(r[2] for r in rows)
    cut, run, k = [], 0.0, 1
    for key, i, x in rows:
        run += x
        if run >= whole * k / ranges and k < ranges:
            cut.append((key, i))
            k = int(run * ranges / whole) + 1
    return _snapped(cut, hot)


def _subdivide(rows: DataFrame, bounds: list, mean: float, drawn, hot: set) -> list[tuple[int, int]]:
    """While a range holds more than ``OVERFULL`` means in several rows, sample it again more densely and cut it."""
    for turn in turns():  # ends when no range is overfull, or when sampling finds no further boundary
        got = rows.groupBy(_range_of(bounds).alias("range")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.max("size").alias("top")).collect()
        over = {r["range"]: r for r in got if r["b"] > OVERFULL * mean and r["n"] > 1 and r["top"] < r["b"] / 2}
        if not over:
            break
        for r in rows.where(_range_of(bounds).isin(list(over)) & (drawn < F.col("size") * F.lit(OVERSAMPLE * 2.0**turn / mean))).select("key", "__id", "size", _range_of(bounds).alias("range")).collect():
            over.setdefault((r["range"], "rows"), []).append(r)
        more = []
        for k, r in over.items():
            if not isinstance(k, tuple):
                drawn_rows = over.get((k, "rows"), [])
                parts = max(2, round(r["b"] / mean))
                picked = sorted((x["key"], x["__id"]) for x in drawn_rows)
                more += [picked[len(picked) * j // parts] for j in range(1, parts) if picked]
        grown = _snapped([*bounds, *more], hot)
        if len(grown) == len(bounds):
            break
        bounds = grown
    return bounds
