"""PrivateFrame: a DataFrame whose rows may be dummies and whose keys may have classes.

Reserved columns: ``__dummy`` (is the row padding?), ``__gen_<col>`` (the class of
``col``; absent while the value itself steers control flow) and ``__host`` (the
owner of a scanned row; gone after a shuffle).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sources import materialize

DUMMY, HOST, GEN = "__dummy", "__host", "__gen_"


class PrivateFrame:
    """Immutable; every operator returns a new one.  ``reveal`` is the only exit for rows."""

    def __init__(self, df: DataFrame):
        self.df = df if DUMMY in df.columns else df.withColumn(DUMMY, F.lit(False))

    # -- shape -------------------------------------------------------------
    @property
    def columns(self) -> list[str]:
        """Data columns."""
        return [c for c in self.df.columns if not c.startswith("__")]

    def gen(self, col: str) -> Column:
        """What steers control flow for ``col``: its class, or its value while it has none."""
        return self.df[GEN + col] if GEN + col in self.df.columns else self.df[col]

    def __getitem__(self, col: str) -> Column:
        return self.df[col]

    def reveal(self) -> DataFrame:
        """The real rows, without reserved columns."""
        return self.df.where(~F.col(DUMMY)).select(*self.columns)

    def padded_count(self) -> int:
        """Rows with padding; count before ``truncate``, which lets Catalyst drop padding."""
        return self.df.count()

    # -- operators ---------------------------------------------------------
    def filter(self, predicate: Column) -> PrivateFrame:
        """Rows that fail (or are unknown) become dummies; the count stays.  Chained filters accumulate."""
        return PrivateFrame(self.df.withColumn(DUMMY, F.col(DUMMY) | ~F.coalesce(predicate, F.lit(False))))

    def project(self, *cols: str | Column) -> PrivateFrame:
        names = [c for c in cols if isinstance(c, str)]
        hidden = [c for c in self.df.columns if c in (DUMMY, HOST) or (c.startswith(GEN) and c[len(GEN) :] in names)]
        return PrivateFrame(self.df.select(*cols, *hidden))

    def join(self, other: PrivateFrame, left_on: str, right_on: str, columns: Iterable[tuple[str, str] | tuple[str, str, str]] | None = None) -> PrivateFrame:
        """Generalized equi-join: rows of one class pair up, and pairs of unequal values are dummies.

        ``columns``: (side 'l' or 'r', name[, alias]) in output order; by default
        all of the left and then of the right side.  Output names must differ.
        """
        left, right = self.df.alias("l"), other.df.alias("r")
        if columns is None:
            columns = [("l", c) for c in self.columns] + [("r", c) for c in other.columns]
        columns = [(s, c, a[0] if a else c) for s, c, *a in columns]
        names = [a for _, _, a in columns]
        if len(set(names)) < len(names):
            raise ValueError(f"output columns repeat: {sorted({n for n in names if names.count(n) > 1})}; give aliases")
        sides = {"l": ("l", self), "r": ("r", other)}
        lg = F.col(f"l.`{GEN + left_on}`") if GEN + left_on in self.df.columns else F.col(f"l.`{left_on}`")
        rg = F.col(f"r.`{GEN + right_on}`") if GEN + right_on in other.df.columns else F.col(f"r.`{right_on}`")
        out = [F.col(f"{s}.`{c}`").alias(a) for s, c, a in columns]
        for s, c, a in columns:
            if GEN + c in sides[s][1].df.columns:
                out.append(F.col(f"{s}.`{GEN + c}`").alias(GEN + a))
        both = F.col(f"l.`{DUMMY}`") | F.col(f"r.`{DUMMY}`")
        # Null-safe, so that its negation is an equi-join key for nullable columns too: truncate() joins on the values.
        key = F.col(f"r.`{right_on}`")
        apart = ~(F.col(f"l.`{left_on}`").eqNullSafe(key) & key.isNotNull())
        return PrivateFrame(left.join(right, lg == rg, "inner").select(*out, (both | apart).alias(DUMMY)))

    def padded_join_size(self, other: PrivateFrame, left_on: str, right_on: str) -> DataFrame:
        """(padded): rows that ``join`` would have with padding, from the counts of each class; nothing is paired."""
        a = self.df.groupBy(self.gen(left_on).alias("c")).agg(F.count(F.lit(1)).alias("a"))
        b = other.df.groupBy(other.gen(right_on).alias("c")).agg(F.count(F.lit(1)).alias("b"))
        return a.join(b, "c").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("padded"))

    def semi_join(self, other: PrivateFrame, left_on: str, right_on: str) -> PrivateFrame:
        keys = other.reveal().select(F.col(right_on).alias(left_on)).distinct()
        return PrivateFrame(self.df.join(keys, left_on, "left_semi").select(*self.df.columns))

    def anti_join(self, other: PrivateFrame, left_on: str, right_on: str) -> PrivateFrame:
        """Rows without a partner among non-null keys (SQL's null-aware NOT IN is plain SQL)."""
        keys = other.reveal().select(F.col(right_on).alias(left_on)).where(F.col(left_on).isNotNull()).distinct()
        return PrivateFrame(self.df.join(keys, left_on, "left_anti").select(*self.df.columns))

    def count_by(self, *keys: str, alias: str = "count", pad_groups: bool = False) -> PrivateFrame:
        return self.aggregate(keys, {alias: F.lit(1)}, how="count", pad_groups=pad_groups)

    def aggregate(self, keys: Iterable[str], values: dict[str, Column | str], how: str = "sum", kanon_col: str | None = None, pad_groups: bool = False) -> PrivateFrame:
        """Group by ``keys``.  how: count, sum, avg, sum_count (columns <name>_sum, <name>_count) or min.

        Dummies never count.  With ``kanon_col`` the aggregation is two-level,
        partials by (keys, class) and then by keys: the same answer, the plan of
        a class-partitioned run.  ``pad_groups`` keeps groups of dummies alone,
        as dummies.
        """
        keys = list(keys)
        real = ~F.col(DUMMY)
        first, last = [F.sum(F.when(real, 1).otherwise(0)).alias("__n")], [F.sum("__n").alias("__n")]
        out = []
        for name, v in values.items():
            v = F.when(real, F.col(v) if isinstance(v, str) else v)
            s, c, m = f"__s_{name}", f"__c_{name}", f"__m_{name}"
            if how == "min":
                first.append(F.min(v).alias(m))
                last.append(F.min(m).alias(m))
                out.append(F.col(m).alias(name))
                continue
            first += [F.sum(v).alias(s), F.count(v).alias(c)]
            last += [F.sum(s).alias(s), F.sum(c).alias(c)]
            if how == "count":
                out.append(F.col(c).alias(name))
            elif how == "sum":
                out.append(F.coalesce(F.col(s), F.lit(0)).alias(name) if pad_groups else F.col(s).alias(name))
            elif how == "avg":
                out.append(F.try_divide(F.col(s), F.col(c)).alias(name))
            elif how == "sum_count":
                out += [F.col(s).alias(f"{name}_sum"), F.col(c).alias(f"{name}_count")]
            else:
                raise ValueError(f"no aggregate {how!r}")
        if kanon_col is None:
            got = self.df.groupBy(*keys).agg(*first)
        else:
            got = self.df.withColumn("__class", self.gen(kanon_col)).groupBy(*keys, "__class").agg(*first).groupBy(*keys).agg(*last)
        got = got if pad_groups else got.where("__n > 0")
        return PrivateFrame(got.select(*keys, *out, (F.col("__n") == 0).alias(DUMMY)))

    def distinct(self) -> PrivateFrame:
        return PrivateFrame(self.reveal().distinct())

    def union(self, other: PrivateFrame) -> PrivateFrame:
        """UNION ALL by position of the data columns."""
        if len(self.columns) != len(other.columns):
            raise ValueError(f"{len(self.columns)} and {len(other.columns)} columns")
        mine, theirs = self.df.select(*self.columns, DUMMY), other.df.select(*other.columns, DUMMY)
        return PrivateFrame(mine.union(theirs))

    def sort(self, *cols: str, ascending: bool = True, per_host: bool = False) -> PrivateFrame:
        order = [F.asc(c) if ascending else F.desc(c) for c in cols]
        return PrivateFrame(self.df.sortWithinPartitions(*order) if per_host else self.df.orderBy(*order))

    def dummy_sort(self, spread: int = 64) -> PrivateFrame:
        """Real rows first.  ``spread`` ranges of a random number keep either kind from meeting in one task."""
        return PrivateFrame(self.df.withColumn("__at", F.floor(F.rand(0) * spread)).orderBy(DUMMY, "__at").drop("__at"))

    def truncate(self) -> PrivateFrame:
        """Drop the padding; Catalyst folds this into the join below, so padding is never built."""
        return PrivateFrame(self.df.where(~F.col(DUMMY)))

    def truncate_to(self, bound: int) -> PrivateFrame:
        """At most ``bound`` rows, real ones first (a cardinality bound on an intermediate result): each task keeps ``bound`` rows, no sort."""
        return PrivateFrame(self.df.orderBy(DUMMY).limit(bound))

    def top(self, n: int, *order: Column | str) -> PrivateFrame:
        return PrivateFrame(self.reveal().orderBy(*order).limit(n))

    def at(self, places: Iterable[int], *order: Column | str) -> PrivateFrame:
        """The rows at ``places`` (from 0) of the order, dummies too, a row for each time that its place is named; places beyond the end give none.

        The sorted rows are numbered by partition, and the sizes of partitions, a row each, make the numbers run on; no task sees all rows.
        """
        rows = materialize(self.df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()), "ordered")
        part, own = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
        sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
        begin, bases = 0, []
        for r in sizes:
            bases.append((r["part"], begin))
            begin += r["n"]
        spark = self.df.sparkSession
        bases = spark.createDataFrame(bases, "__part long, __base long")
        wanted = spark.createDataFrame([(int(i),) for i in places], "__place long")
        found = rows.join(F.broadcast(bases), part == F.col("__part")).join(wanted, own + F.col("__base") == F.col("__place"))
        return PrivateFrame(found.select(*self.df.columns))

    def sample(self, n: int, seed: int = 0) -> PrivateFrame:
        return PrivateFrame(self.reveal().orderBy(F.rand(seed)).limit(n))

    def repartition(self, n: int, *cols: str, shuffle_first: bool = False) -> PrivateFrame:
        """Rows of one class of ``cols`` go to one host: hash of the classes modulo ``n``.

        ``__host`` is the new host.  ``shuffle_first`` adds the random step that
        hides where a row came from; it changes no result.
        """
        df = self.df.repartition(n) if shuffle_first else self.df
        host = F.pmod(F.xxhash64(*[F.col(GEN + c) if GEN + c in df.columns else F.col(c) for c in cols]), F.lit(n)).cast("int")
        placed = df.withColumn(HOST, host)
        return PrivateFrame(placed.repartitionById(n, F.col(HOST)))  # partition h is host h

    def make_oblivious(self, col: str) -> PrivateFrame:
        """One class for all: joins on ``col`` pair everything."""
        return PrivateFrame(self.df.withColumn(GEN + col, F.lit(0).cast("long")))

    def generalize(self, col: str, gen_map: DataFrame) -> PrivateFrame:
        """Attach classes from a map (key, gen); rows of label -1 or of no label go.  A second map replaces the first."""
        labels = gen_map.where("gen <> -1").select(F.col("key").alias("__key"), F.col("gen").alias("__new"))
        df = self.df.drop(GEN + col)
        return PrivateFrame(df.join(labels, df[col] == labels["__key"]).drop("__key").withColumnRenamed("__new", GEN + col))
