"""Sources and sinks: Parquet tables, JDBC, SQL, random tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The column types that the federation's tables may have in strict mode.
STRICT = (T.StringType, T.CharType, T.VarcharType, T.IntegerType, T.LongType, T.ShortType, T.FloatType, T.DoubleType, T.DecimalType, T.TimestampType, T.TimestampNTZType, T.DateType)


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temp views of Parquet tables, for SQL."""
    for n in names:
        parquet(spark, sf_dir, n).createOrReplaceTempView(n)


def query(spark: SparkSession, sql: str) -> DataFrame:
    """Errors propagate; nothing is dropped silently."""
    return spark.sql(sql)


def jdbc(spark: SparkSession, url: str, sql: str, **options: str) -> DataFrame:
    """A query against PostgreSQL or another JDBC source; pass partitionColumn, lowerBound, upperBound and numPartitions to read in parallel."""
    table = {"dbtable": f"({sql}) AS q"} if "partitionColumn" in options else {"query": sql}
    return spark.read.format("jdbc").options(url=url, **table, **options).load()


def check_types(df: DataFrame) -> DataFrame:
    """Raise ValueError for a column type that owners can't exchange."""
    bad = [f"{f.name}: {f.dataType.simpleString()}" for f in df.schema if not isinstance(f.dataType, STRICT)]
    if bad:
        raise ValueError(f"unsupported column types: {', '.join(bad)}")
    return df


def exchange_types(df: DataFrame) -> DataFrame:
    """(name, type) of a table's columns as owners exchange them: text, integer, double (decimals too) or timestamp (dates too); other types raise ValueError."""
    kinds = ((T.StringType, "text"), (T.IntegralType, "integer"), (T.NumericType, "double"), ((T.TimestampType, T.TimestampNTZType, T.DateType), "timestamp"))
    rows = [(f.name, next(kind for types, kind in kinds if isinstance(f.dataType, types))) for f in check_types(df).schema]
    return df.sparkSession.createDataFrame(rows, "name string, type string")


def random_table(spark: SparkSession, rows: int, seed: int = 0, **columns: int) -> DataFrame:
    """Uniform integers from 1 to n for each column=n."""
    return spark.range(rows).select(*[(F.floor(F.rand(seed + i) * n) + 1).cast("long").alias(c) for i, (c, n) in enumerate(columns.items())])


def save(df: DataFrame, name: str, mode: str = "errorifexists") -> None:
    """CREATE TABLE AS."""
    df.write.mode(mode).saveAsTable(name)


def create_table_as(spark: SparkSession, name: str, sql: str) -> DataFrame:
    """CREATE TABLE AS in the shared folder, with a view of that name; ``free`` deletes the table."""
    out = materialize(query(spark, sql), name)
    out.createOrReplaceTempView(name)
    return out


def fetch(df: DataFrame, limit: int | None = None) -> list:
    """Rows to the driver; ``limit`` bounds them."""
    return (df if limit is None else df.limit(limit)).collect()


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


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again; ``free`` deletes it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._anon_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote; nothing may read it any more."""
    for t in tables:
        path = getattr(t, "_anon_path", None)
        if path:
            p = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
