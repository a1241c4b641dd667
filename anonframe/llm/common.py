"""Shared plumbing: tables in the shared folder and star contraction."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark deletes a write's shuffle files when the write is over, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Links that one task contracts at once.
CHUNK_LINKS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    A session in one process (master ``local``) without that setting gets a
    temporary folder and keeps it; on a cluster the setting must be there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="anonframe-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts lineage: a lost executor costs the tasks that it ran, not the stages
    before them.  ``release`` deletes the folder once its readers are done; a
    table that a returned, lazy result still reads stays until the cluster
    clears the shared folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._anon_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote; their readers must have run."""
    for t in tables:
        path = getattr(t, "_anon_path", None)
        if path:
            jvm = t.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _contracted(links: DataFrame) -> DataFrame:
    """``links`` (a, b) with each chunk of CHUNK_LINKS rows as stars: every node with the smallest that it reaches inside the chunk."""

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        low = np.arange(len(ids))
        while True:
            m = np.minimum(low[x], low[y])
            new = low.copy()
            for end in (x, y, low[x], low[y]):
                np.minimum.at(new, end, m)
            while not np.array_equal(new[new], new):
                new = new[new]
            if np.array_equal(new, low):
                break
            low = new
        far = low != np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[far], pa.int64()), pa.array(ids[low[far]], pa.int64())], names=["a", "b"])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")))
            if sum(len(a) for a, _ in held) >= CHUNK_LINKS:
                yield stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
        if held:
            yield stars(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return links.mapInArrow(run, "a long, b long")


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of ``links`` (a long, b long): rows (id, comp).

    Each partition contracts its own links to stars; then come rounds of large
    and small stars, grouped minima and joins on node ids, each contracted
    again.  Rounds grow with the logarithm of the longest chain, and end when
    every node has one smaller neighbour that has none itself.  ``comp`` is the
    smallest id that is reachable.  Ids without a link, and links of an id with
    itself, are absent.  Raises if ``max_rounds`` do not suffice.  The result
    reads one materialized table, for the caller to release.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:  # every node with its smaller neighbours
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(low, "u")
        if large:
            out = out.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    edges = materialize(_contracted(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), "edges")
    for _ in range(max_rounds):
        ends = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("to")))
        ends = ends.groupBy("id").agg((F.min("to") < F.max("to")).alias("open"))
        if ends.where("open").isEmpty():
            ids = edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("comp")))
            out = ids.distinct()
            out._anon_path = edges._anon_path
            return out
        new = materialize(_contracted(star(star(edges, True), False)), "edges")
        release(edges)
        edges = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
