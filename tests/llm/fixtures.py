"""Small documents with the awkward cases, and the brute-force pieces that tests share."""

import re

from pyspark.sql import functions as F

SPACE = re.compile(r"[^\x20\x09-\x0d]+")
ALNUM = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def documents(spark, sf, n=120):
    """Driver rows plus nulls, empty, blank, very long, repeated and non-ASCII texts; an extra column named like an inner one."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(n)
    base = [r["text"] for r in docs.orderBy("doc_id").limit(3).collect()]
    long_text = " ".join(f"w{i % 977} x{i % 31}" for i in range(9000))
    extra = [(10_000, None), (10_001, ""), (10_002, " \n\t "), (10_003, long_text), (10_004, long_text + " end"), (10_005, "one two"), (10_006, "One  TWO"), (10_007, base[0]), (10_008, base[0] + " tail"), (10_009, "日本語 テキスト 😀 é"), (10_010, "a b c d e f g h"), (10_011, "same " * 400)]
    more = spark.createDataFrame(extra, "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    return docs.withColumn("id", F.lit("clash")).withColumn("n", F.lit(-1)).withColumn("rank", F.lit(None).cast("int"))


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
