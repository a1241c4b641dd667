"""Class maps: k-anonymous ranges of join keys over several relations and owners.

Counts are one distributed aggregation.  Classes are greedy ranges of ascending
keys, so where one begins depends on all before it; but what a range partition
of the keys does to the walk can be told in advance.  A partition's summary says
where each owner's sums first reach 1 to k (the open class closes there) and, for
each such place, where the partition's last class then begins and what it has
collected.  The driver walks over summaries, whose size depends on relations,
owners and k alone, and the partitions label their keys in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import HOST
from ..sources import free, materialize

#: Keys of a range partition, about.
CHUNK_KEYS = 1_000_000
#: Keys that the older, driver-side forms take; they are for small domains and refuse larger ones.
SMALL_DOMAIN = 1_000_000


def key_counts(df: DataFrame, column: str) -> DataFrame:
    """(host, key, n); null keys have no class and are left out."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(HOST).alias("host"), F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@dataclass
class GenMap:
    """``df`` (key, gen); label -1 marks keys that some relation lacks."""

    df: DataFrame
    counts: dict[str, DataFrame]
    n_hosts: int
    k: int
    criterion: str

    def free(self) -> None:
        """Delete the labels' table; frames that carry classes of this map can't be read afterwards."""
        free(self.df)

    def class_stats(self) -> DataFrame:
        """Classes, and the least, most and mean keys of one."""
        per = self.df.where("gen <> -1").groupBy("gen").agg(F.count(F.lit(1)).alias("n"))
        return per.agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("min_keys"), F.max("n").alias("max_keys"), F.avg("n").alias("avg_keys"))

    def verify(self, criterion: str | None = None) -> DataFrame:
        """(relation, gen, ok): does each class meet the criterion for each relation?"""
        return verify(self.df, self.counts, self.n_hosts, self.k, criterion or self.criterion)


def _views(counts: DataFrame, hosts: int, criterion: str) -> DataFrame:
    """(key, array of the others' counts by host): tuples of the key that hosts other than h hold.

    Under ``range`` a key of one owner counts in full for that owner too.
    """
    own = [F.sum(F.when(F.col("host") == h, F.col("n")).otherwise(0)) for h in range(hosts)]
    got = counts.groupBy("key").agg(F.array(*own).alias("own"))
    total = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x)
    if criterion == "range":
        return got.select("key", F.transform("own", lambda x: F.when(total == x, total).otherwise(total - x)).alias("v"))
    return got.select("key", F.col("own").alias("v"))


def domain(counts: dict[str, DataFrame]) -> DataFrame:
    """(key, everywhere): is the key in every relation?"""
    out = None
    for i, c in enumerate(counts.values()):
        c = c.select("key").distinct().withColumn("rel", F.lit(i))
        out = c if out is None else out.unionByName(c)
    return out.groupBy("key").agg((F.count(F.lit(1)) == len(counts)).alias("everywhere"))


def range_map(counts: dict[str, DataFrame], hosts: int, k: int, criterion: str = "range", parity: bool = False) -> GenMap:
    """Greedy ranges of ascending keys; a class's label is the index of its first key.

    criterion 'range': each owner's view of the others, summed over the class,
    reaches k in every relation.  'complement': the class's tuples less the
    owner's own reach k, or one owner has them all and they reach k.  A tail that
    can't close joins the class before.  ``parity`` instead goes on for as long as
    any relation still closes.
    """
    if criterion not in ("range", "complement"):
        raise ValueError(f"no criterion {criterion!r}")
    views, names = None, [f"v{i}" for i in range(len(counts))]
    for name, c in zip(names, counts.values(), strict=True):
        v = _views(c, hosts, criterion).withColumnRenamed("v", name)
        views = v if views is None else views.join(v, "key", "inner")
    views = materialize(views, "views")
    kind = views.schema["key"].dataType.simpleString()
    if criterion == "complement":
        labels = _stream(views, names, hosts, k, kind)
    else:
        labels = _labels(views, names, hosts, k, kind, parity)
    if len(counts) > 1:
        gone = domain(counts).where(~F.col("everywhere")).select("key", F.lit(-1).cast("long").alias("gen"))
        labels = labels.unionByName(gone)
    labels = materialize(labels, "classes")
    free(views)
    return GenMap(labels, counts, hosts, k, criterion)


def _arrays(t: pa.Table, names: list[str], hosts: int) -> np.ndarray:
    """counts[key, relation, host] in the order of the rows."""
    return np.stack([np.asarray(t.column(n).combine_chunks().flatten(), np.int64).reshape(-1, hosts) for n in names], axis=1)


class Chunk:
    """Ascending keys of one partition: ``counts[key, relation, host]``."""

    def __init__(self, counts: np.ndarray, k: int, live: list[int]):
        self.n, self.k, self.live = len(counts), k, live
        self.total = np.concatenate([np.zeros((1, *counts.shape[1:]), np.int64), np.cumsum(counts, axis=0)])
        # stop[i]: where a class that begins at i ends, if it does so here; n + 1 if not.
        self.stop = np.zeros(self.n + 1, np.int64)
        for r in live:
            for h in range(counts.shape[2]):
                t = self.total[:, r, h]
                self.stop = np.maximum(self.stop, np.searchsorted(t, t + k, "left"))

    def summary(self, start: int | None) -> dict:
        """What the walk over partitions needs; ``start``: a place where a class begins in any case."""
        heads = np.stack([[np.searchsorted(self.total[:, r, h], np.arange(1, self.k + 1), "left") for h in range(self.total.shape[2])] for r in self.live])
        cand = np.unique(np.r_[heads.ravel(), [] if start is None else [start]]).astype(np.int64)
        cand = cand[cand <= self.n]
        known: dict[int, tuple[int, int]] = {}
        for i in cand.tolist():
            path = []
            while i not in known and self.stop[i] <= self.n:
                path.append(i)
                i = int(self.stop[i])
            last, before = known.get(i, (i, -1))
            known[i] = last, before
            for j in reversed(path):
                before = j if before < 0 else before
                known[j] = last, before
        last, before = (np.array([known[i][x] for i in cand.tolist()], np.int64) for x in (0, 1))
        carry = np.minimum(self.total[self.n] - self.total[last], self.k) if len(cand) else np.zeros((0, *self.total.shape[1:]), np.int64)
        return {"n": self.n, "sum": np.minimum(self.total[self.n], self.k), "heads": heads, "cand": cand, "last": last, "before": before, "carry": carry}

    def classes(self, begin: int) -> list[tuple[int, int]]:
        """(first key, end) of the classes from ``begin`` on; the last may be open."""
        out, i = [], begin
        while i < self.n:
            end = min(int(self.stop[i]), self.n)
            out.append((i, end))
            i = end
        return out


def walk(summaries: list[dict], k: int, live: list[int], start: int = 0, before: int = 0):
    """The greedy walk from key number ``start`` over partitions in order of their keys.

    Returns (entry of each partition: (first place where a class begins, label of
    the keys before it or None), first key of the open class at the end, label
    of the class before it, its sums up to k).
    """
    entries, base = [], 0
    carry, label, begun = None, start, False
    for s in summaries:
        n = s["n"]
        if not begun and start < base + n:
            at, entry, begun = start - base, (start - base, None), True
        elif not begun:
            entries.append((n, None))
            base += n
            continue
        else:
            need = k - carry[live]
            at = 0
            for r, h in np.argwhere(need > 0).tolist():
                at = max(at, int(s["heads"][r, h, need[r, h] - 1]))
            if at > n:
                carry = np.minimum(carry + s["sum"], k)
                entries.append((n, label))
                base += n
                continue
            entry = (at, label)
            before = label
        j = int(np.searchsorted(s["cand"], at))
        before = base + int(s["before"][j]) if s["before"][j] >= 0 else before
        carry, label = s["carry"][j], base + int(s["last"][j])
        entries.append(entry)
        base += n
    return entries, label, before, carry


def label_chunk(n: int, base: int, phases: list[tuple[int, Chunk | None, tuple]], tail: tuple[int, int]) -> np.ndarray:
    """Labels of a partition's keys; each phase (first key, chunk, entry) writes over the one before, the open tail over all."""
    out = np.zeros(n, np.int64)
    for _, chunk, (at, label) in phases:
        if label is not None:
            out[:at] = label
        for a, b in chunk.classes(at):
            out[a:b] = base + a
    first, before = tail
    out[max(0, first - base) :] = before
    return out


def _phases(summaries, order: list[int], n: int, k: int, relations: int, parity: bool) -> tuple[list, tuple[int, int]]:
    """Walks over all partitions, the first with every relation, ``parity`` ones with those that still close: ([(start, relations, entries)], tail)."""
    phases: list[tuple[int, list[int], dict]] = []
    live, start, before, tail = list(range(relations)), 0, 0, (0, 0)
    while order:
        entries, first, before, carry = walk(summaries(live, start), k, live, start, before)
        phases.append((start, live, dict(zip(order, entries, strict=True))))
        closing = [r for r in live if carry is not None and (carry[r] >= k).all()]
        tail, start = (first, before), first
        if not parity or not closing or first >= n:
            break
        live = closing
    return phases, tail


def _labels(views: DataFrame, names: list[str], hosts: int, k: int, kind: str, parity: bool) -> DataFrame:
    """(key, gen) under 'range': one pass for the summaries, if there are several partitions, and one for the labels; parity adds a pass a relation at most."""
    n = views.count()
    parts = max(1, -(-n // CHUNK_KEYS))
    if parts > 1:
        ranged = materialize(views.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()), "ranges")
    else:
        ranged = views.withColumn("part", F.lit(0))
    sizes = dict.fromkeys(range(parts), 0) | ({r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()} if parts > 1 else {0: n})  # a row a partition
    order = [p for p in range(parts) if sizes[p]]
    bases = dict(zip(order, np.cumsum([0, *(sizes[p] for p in order)]).tolist(), strict=False))

    def summaries(live: list[int], start: int) -> list[dict]:
        def run(group: pa.Table) -> pa.Table:
            part = group.column("part")[0].as_py()
            own = start - bases[part]
            s = Chunk(_arrays(group.sort_by("key"), names, hosts), k, live).summary(own if 0 <= own < group.num_rows else None)
            fields = ("heads", "cand", "last", "before", "carry", "sum")
            return pa.table({"part": pa.array([part], pa.int32()), "n": [s["n"]], **{f: pa.array([s[f].ravel().tolist()], pa.list_(pa.int64())) for f in fields}})

        got = ranged.groupBy("part").applyInArrow(run, "part int, n long, heads array<long>, cand array<long>, last array<long>, before array<long>, carry array<long>, sum array<long>").collect()
        shapes = {"heads": (len(live), hosts, k), "carry": (-1, len(names), hosts), "sum": (len(names), hosts)}
        return [{"n": r["n"], **{f: np.array(r[f], np.int64).reshape(shapes.get(f, -1)) for f in ("heads", "cand", "last", "before", "carry", "sum")}} for r in sorted(got, key=lambda r: r["part"])]

    def label(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        part = group.column("part")[0].as_py()
        counts = _arrays(group, names, hosts)
        phases, tail = walked or _phases(lambda live, start: [Chunk(counts, k, live).summary(start if start < n else None)], order, n, k, len(names), parity)
        done = [(first, Chunk(counts, k, live), at[part]) for first, live, at in phases if first < bases[part] + len(counts)]
        out = label_chunk(len(counts), bases[part], done, tail)
        return pa.table({"key": group.column("key"), "gen": pa.array(out, pa.int64())})

    # The task that has all keys walks by itself.
    walked = _phases(summaries, order, n, k, len(names), parity) if parts > 1 else None
    return ranged.groupBy("part").applyInArrow(label, f"key {kind}, gen long")


def _stream(views: DataFrame, names: list[str], hosts: int, k: int, kind: str) -> DataFrame:
    """(key, gen) under 'complement', which is not monotone: one executor task reads the sorted partitions one after another and holds the open class."""

    def run(batches):
        at, label, total, keys = 0, 0, np.zeros((len(names), hosts), np.int64), []
        for batch in batches:
            counts = _arrays(pa.Table.from_batches([batch]), names, hosts)
            begin, out, labels = 0, [], []
            for i, c in enumerate(counts):
                total = total + c
                if all(meets_complement(row, k) for row in total):
                    held = [*keys, batch.column("key").slice(begin, i + 1 - begin)]
                    m = sum(map(len, held))
                    out += held
                    labels.append(np.full(m, at))
                    label, at, keys, begin = at, at + m, [], i + 1
                    total = np.zeros_like(total)
            keys.append(batch.column("key").slice(begin))
            if labels:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(out), pa.array(np.concatenate(labels), pa.int64())], names=["key", "gen"])
        if sum(map(len, keys)):
            rest = pa.concat_arrays(keys)
            yield pa.RecordBatch.from_arrays([rest, pa.array(np.full(len(rest), label), pa.int64())], names=["key", "gen"])

    return views.orderBy("key").coalesce(1).mapInArrow(run, f"key {kind}, gen long")


def meets_complement(own, k: int) -> bool:
    """own: a class's tuples by host."""
    total = int(sum(own))
    return total >= k if sum(x > 0 for x in own) == 1 else all(total - x >= k for x in own)


def verify(labels: DataFrame, counts: dict[str, DataFrame], hosts: int, k: int, criterion: str) -> DataFrame:
    out = None
    for name, c in counts.items():
        v = _views(c, hosts, criterion).join(labels.where("gen <> -1"), "key")
        sums = v.groupBy("gen").agg(F.array(*[F.sum(F.col("v")[h]) for h in range(hosts)]).alias("v"))
        total = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x)
        if criterion == "range":
            ok = F.forall("v", lambda x: x >= k)
        else:
            ok = F.when(F.size(F.filter("v", lambda x: x > 0)) == 1, total >= k).otherwise(F.forall("v", lambda x: total - x >= k))
        sums = sums.select(F.lit(name).alias("relation"), "gen", ok.alias("ok"))
        out = sums if out is None else out.unionByName(sums)
    return out


def range_reaches(counts: dict[str, DataFrame], hosts: int, k: int, low, high) -> DataFrame:
    """(relation, ok): do the keys from ``low`` to before ``high``, as one class, show each owner k tuples of the others?  An empty range does only for k = 0."""
    out = None
    for name, c in counts.items():
        others = [F.coalesce(F.sum(F.when(F.col("host") != h, F.col("n"))), F.lit(0)) >= k for h in range(hosts)]
        row = c.where((F.col("key") >= low) & (F.col("key") < high)).agg(F.forall(F.array(*others), lambda x: x).alias("ok")).select(F.lit(name).alias("relation"), "ok")
        out = row if out is None else out.unionByName(row)
    return out


def _small(views: DataFrame) -> list:
    rows = views.limit(SMALL_DOMAIN + 1).collect()
    if len(rows) > SMALL_DOMAIN:
        raise ValueError(f"more than {SMALL_DOMAIN} keys; use range_map")
    return rows


def dense_range_map(counts: dict[str, DataFrame], hosts: int, k: int) -> DataFrame:
    """The older range form: all integers from 0 to the largest key, labelled by their range's first number, under 'complement'.

    Raises ValueError if some but not all relations run out.  Driver-side, for
    integer domains of at most SMALL_DOMAIN keys; raises for larger ones.
    """
    own = [{r["key"]: r["v"] for r in _small(_views(c, hosts, "complement"))} for c in counts.values()]
    top = max((max(o) for o in own if o), default=-1)
    spark = next(iter(counts.values())).sparkSession
    labels, begin, before = [], 0, 0
    while begin <= top:
        ends = []
        for o in own:
            total, end = np.zeros(hosts, np.int64), -1
            for i in range(begin, top + 1):
                total = total + np.array(o.get(i, [0] * hosts))
                if total.sum() and meets_complement(total, k):
                    end = i
                    break
            ends.append(end)
        if min(ends) == -1 and max(ends) != -1:
            raise ValueError("a relation has too few tuples beyond " + str(begin))
        stop = top if max(ends) == -1 else max(ends)
        label = before if max(ends) == -1 else begin
        labels += [(i, label) for i in range(begin, stop + 1)]
        before, begin = begin, stop + 1
    return spark.createDataFrame(labels, "key long, gen long")


def greedy_merge_map(counts: DataFrame, hosts: int, k: int) -> DataFrame:
    """The older greedy form for one relation: classes that fail 'complement' are merged, small with large.

    Ties go by the smaller label.  A last failing class joins the smallest other
    one.  Driver-side, for at most SMALL_DOMAIN keys; raises for larger domains.
    """
    groups = {r["key"]: ([r["key"]], np.array(r["v"], np.int64)) for r in _small(_views(counts, hosts, "complement"))}

    def into(a, b):
        keys, own = groups.pop(b)
        groups[a] = (groups[a][0] + keys, groups[a][1] + own)

    while True:
        failing = sorted((int(v.sum()), g) for g, (_, v) in groups.items() if not meets_complement(v, k))
        if not failing:
            break
        if len(failing) == 1:
            others = sorted((int(v.sum()), g) for g, (_, v) in groups.items() if g != failing[0][1])
            if not others:
                break
            into(others[0][1], failing[0][1])
            continue
        small, large = 0, len(failing) - 1
        while small < large:
            a = failing[small][1]
            into(a, failing[large][1])
            large -= 1
            while large > small and not meets_complement(groups[a][1], k):
                into(a, failing[large][1])
                large -= 1
            small += 1
    spark = counts.sparkSession
    return spark.createDataFrame([(key, g) for g, (keys, _) in groups.items() for key in keys], f"key {counts.schema['key'].dataType.simpleString()}, gen {counts.schema['key'].dataType.simpleString()}")
