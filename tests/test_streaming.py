from pyspark.sql import functions as F

from tests.fixtures import region
from veilwright import schemas
from veilwright.streaming import observations as S

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_hits_stream_like_in_batch(spark, tmp_path):
    rows = spark.createDataFrame([region(k, f"mail u{k}@example.com and 9876543210") for k in range(5)], schemas.REGIONS)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = S.stream_hits(stream).writeStream.format("memory").queryName("hits").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("hits").collect())) == sorted(map(tuple, S.stream_hits(rows).collect()))


def test_last_rows_per_key(spark, tmp_path):
    rows = spark.read.parquet(EVENTS)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = S.stream_last(stream, "user_id", "event_id", "ts").writeStream.format("memory").queryName("last").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    batch = S.last_per_key(spark.read.parquet(EVENTS), "user_id", F.col("ts").desc(), F.col("event_id").desc())
    assert sorted((r.key, r.ident) for r in spark.table("last").collect()) == sorted((str(r.user_id), r.event_id) for r in batch.collect())


def test_whole_observations_by_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "observation_id string, text string")
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    q = S.handle_observations(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), lambda df, n: seen.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sum(seen) == 2


def test_windowed_counts(spark, tmp_path):
    e = spark.read.parquet(EVENTS).selectExpr("ts", "event_type as type")
    assert S.windowed_counts(e).agg(F.sum("n")).first()[0] == e.count()
