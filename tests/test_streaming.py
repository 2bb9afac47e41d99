"""A finished stream says what the batch says."""

from pyspark.sql import functions as F

from ledgerloom.streaming import events
from tests.conftest import SF_TINY


def run(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_windows_and_sessions_of_unique_events(spark, tmp_path):
    base = spark.read.parquet(f"{SF_TINY}/events.parquet")
    path = str(tmp_path / "in")
    base.coalesce(1).write.parquet(path)
    base.sample(0.3, 1).coalesce(1).write.mode("append").parquet(path)
    unique = events.once(events.source(spark, path), "30 days")
    got = run(spark, unique.select("event_id"), "unique_events", tmp_path)
    assert got.count() == base.count() == got.distinct().count()
    batch = base.withColumn("ts", F.col("ts").cast("timestamp"))
    once = str(tmp_path / "once")
    base.write.parquet(once)
    for name, of in (("by_window", events.by_window), ("sessions", events.sessions)):
        streamed = run(spark, of(events.source(spark, once).withWatermark("ts", "1 minute")), name, tmp_path)
        said = {tuple(r)[:-1] for r in of(batch).collect()}
        # Windows that the watermark hasn't closed stay in the state.
        assert streamed.count() > 0 and {tuple(r)[:-1] for r in streamed.collect()} <= said
