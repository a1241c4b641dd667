"""Federation: owners' horizontal slices of shared tables, and queries over them."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import HOST, PrivateFrame
from .plans.generalize import GenMap, key_counts, range_map
from .sources import shared_dir


class Federation:
    """``n_hosts`` owners; a registered table says which owner holds a row."""

    def __init__(self, spark: SparkSession, n_hosts: int):
        self.spark, self.n_hosts = spark, n_hosts
        self.tables: dict[str, DataFrame] = {}

    def register(self, name: str, df: DataFrame, host: Column | str) -> None:
        """host: a column expression; its value modulo ``n_hosts`` is the owner."""
        host = F.expr(host) if isinstance(host, str) else host
        self.tables[name] = df.withColumn(HOST, F.pmod(host, F.lit(self.n_hosts)).cast("int"))
        self.tables[name].createOrReplaceTempView(f"fed_{name}")

    def register_slices(self, name: str, slices: Iterable[DataFrame]) -> None:
        """One DataFrame for each owner (a schema of its own each, say): UNION ALL by name."""
        out = None
        for h, df in enumerate(slices):
            df = df.withColumn(HOST, F.lit(h))
            out = df if out is None else out.unionByName(df)
        self.tables[name] = out
        out.createOrReplaceTempView(f"fed_{name}")

    def scan(self, table: str, columns: Iterable[str] | None = None, where: Column | str | None = None, hosts: Iterable[int] | None = None) -> PrivateFrame:
        """Rows of all owners, or of ``hosts``, after a filter and projection that reach the files."""
        df = self.tables[table]
        if hosts is not None:
            df = df.where(F.col(HOST).isin(list(hosts)))
        if where is not None:
            df = df.where(where)
        return PrivateFrame(df.select(*columns, HOST) if columns is not None else df)

    def scan_sql(self, sql: str, host: Column | None = None) -> PrivateFrame:
        """SQL over the views fed_<table>; ``host`` tells the owner if the result has no __host."""
        df = self.spark.sql(sql)
        return PrivateFrame(df if host is None else df.withColumn(HOST, host))

    def counts(self, table: str, column: str) -> DataFrame:
        """(host, key, n) of a base table's column."""
        return key_counts(self.tables[table], column)

    def gen_map(self, columns: dict[str, str], k: int, criterion: str = "range", parity: bool = False) -> GenMap:
        """Classes over the base tables' columns {table: column}."""
        return range_map({t: self.counts(t, c) for t, c in columns.items()}, self.n_hosts, k, criterion=criterion, parity=parity)

    def gen_maps(self, joins: Iterable[dict[str, str]], k: int, **how) -> list[GenMap]:
        """The maps of several joins' columns, built by concurrent jobs: none needs another, and each alone leaves most cores idle."""
        joins = list(joins)
        shared_dir(self.spark)  # settled before threads ask for it
        build = inheritable_thread_target(self.spark)(lambda columns: self.gen_map(columns, k, **how))
        with ThreadPoolExecutor(max(1, len(joins))) as pool:
            return list(pool.map(build, joins))

    def generalize(self, frames: dict[str, tuple[PrivateFrame, str]], k: int, counts_from: str = "base", classes: GenMap | None = None, **how) -> tuple[dict[str, PrivateFrame], GenMap]:
        """{table: (scan, column)} -> scans with classes, and the map.

        Counts come from the base tables, as owners publish them once;
        ``counts_from='scan'`` takes the filtered scans instead, and ``classes``
        is a map that is there already (of ``gen_maps``, say).
        """
        if classes is not None:
            m = classes
        elif counts_from == "base":
            m = self.gen_map({t: c for t, (_, c) in frames.items()}, k, **how)
        else:
            m = range_map({t: key_counts(f.df, c) for t, (f, c) in frames.items()}, self.n_hosts, k, **how)
        return {t: f.generalize(c, m.df) for t, (f, c) in frames.items()}, m

    def with_local(self, distributed: PrivateFrame, local: PrivateFrame) -> PrivateFrame:
        """The owners' local branch next to the distributed one."""
        return distributed.union(local)
