import shutil

from pyspark.sql import functions as F

from tessellum.streaming import incremental


def test_windowed_activity_equals_the_batch(spark, data, tmp_path):
    folder = tmp_path / "events"
    spark.read.parquet(f"{data}/events.parquet").orderBy("ts").repartition(1).write.parquet(str(folder))
    stream = incremental.activity(incremental.read_events(spark, str(folder)), late="3650 days")
    query = stream.writeStream.format("memory").queryName("activity").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("activity").agg(F.sum("n")).first()[0]
    assert got == spark.read.parquet(f"{data}/events.parquet").count()
    shutil.rmtree(folder)


def test_first_seen(spark, data, tmp_path):
    folder = tmp_path / "events"
    spark.read.parquet(f"{data}/events.parquet").repartition(2).write.parquet(str(folder))
    stream = incremental.first_seen(incremental.read_events(spark, str(folder)), "user_id", "3650 days")
    query = stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("seen").count() == spark.read.parquet(f"{data}/events.parquet").select("user_id").distinct().count()
