from anonframe.streaming import event_counts

from .compare import spark_rows


def test_stream_equals_table(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet")
    source = str(tmp_path / "in")
    table.repartition(3).write.parquet(source)
    q = event_counts(spark.readStream.schema(table.schema).parquet(source)).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    try:
        q.processAllAvailable()
        got = spark.table("counts").selectExpr("window_start", "event_type", "n", "round(total, 4) AS total")
        assert spark_rows(got) == spark_rows(event_counts(table).selectExpr("window_start", "event_type", "n", "round(total, 4) AS total"))
    finally:
        q.stop()
