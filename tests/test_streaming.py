from pyspark.sql import functions as F

from voxloom.streaming import windows


def run(spark, make, schema, rows, tmp_path, name):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / name))
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name != "sessions" else "append").start()
    query.processAllAvailable()
    query.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_smoothed_stream(spark, tmp_path):
    rows = spark.range(60).select(F.timestamp_seconds(F.col("id") * 120).alias("ts"), F.col("id").cast("double").alias("loss")).collect()
    got = run(spark, windows.smoothed_stream, "ts timestamp, loss double", rows, tmp_path, "smoothed_log")
    assert sorted(r.smoothed for r in got) == [14.5, 44.5]


def test_occupied_stream(spark, tmp_path):
    rows = spark.range(10).select(F.timestamp_seconds("id").alias("ts"), *[(F.col("id") % 2 + 0.5).alias(c) for c in "xyz"]).collect()
    got = run(spark, windows.occupied_stream, "ts timestamp, x double, y double, z double", rows, tmp_path, "occupied_now")
    assert sorted((r.h, r.points) for r in got) == [(0, 5), (1, 5)]
