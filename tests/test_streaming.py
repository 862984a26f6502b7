"""Streams against their batch forms."""

from pyspark.sql import functions as F

from gridspan.streaming import views


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_unlock_stream(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.from_json("props", "k int")["k"].cast("string").alias("item"))
    for part in range(3):
        e.filter(F.col("event_id") % 3 == part).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = [r.user_id for r in run(views.unlock_stream(stream, "user_id", "item"), "unlocked").collect()]
    want = [r.user_id for r in views.unlocks(e, "user_id", "item", ["event_id"]).collect()]
    assert sorted(got) == sorted(want)  # once each


def test_chunk_states(spark, tmp_path):
    rows = [("s", "a", "want", 0), ("s", "a", "want", 10), ("s", "b", "want", 20), ("s", "b", "failed", 30), ("s", "b", "want", 1000), ("s", "a", "built", 1100), ("s", "b", "want", 3100), ("s", "a", "drop", 3200)]
    d = spark.createDataFrame(rows, "session string, chunk string, kind string, ms long")
    d.coalesce(1).write.parquet(str(tmp_path / "c"))
    got = run(views.chunk_state_stream(spark.readStream.schema(d.schema).parquet(str(tmp_path / "c")), "session"), "states").collect()
    assert [(r.chunk, r.action) for r in got] == [("a", "request"), ("b", "request"), ("b", "request"), ("a", "evict")]
