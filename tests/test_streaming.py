from __future__ import annotations

from cadenza.streaming import windows
from tests.conftest import rows

SPANS = "source_id string, ts timestamp, start_ms long, end_ms long"


def test_level_buckets_in_a_stream(spark, tmp_path):
    spark.sql("SELECT 'a' AS source_id, timestamp_millis(id * 500) AS ts, CAST(-20 AS DOUBLE) AS rms_db FROM range(40)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source_id string, ts timestamp, rms_db double").parquet(str(tmp_path / "in"))
    query = windows.level_buckets(stream, late="1 second").writeStream.format("memory").queryName("levels").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.sql("SELECT round(level_db, 6) AS db, frames FROM levels").collect()
    assert len(got) == 10 and {tuple(r) for r in got} == {(-20.0, 4)}


def test_spans_merge_across_batches(spark, tmp_path):
    folder = str(tmp_path / "spans")
    for i, items in enumerate([[(0, 10), (50, 60)], [(8, 20), (200_000, 200_001)], [(400_000, 400_001)]]):
        spark.createDataFrame([("a", s, e) for s, e in items], "source_id string, start_ms long, end_ms long").selectExpr("source_id", "timestamp_millis(end_ms) AS ts", "start_ms", "end_ms").coalesce(1).write.mode("append").parquet(f"{folder}/b{i}")
    stream = spark.readStream.schema(SPANS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    query = windows.merged_spans(stream, late="1 second").writeStream.format("memory").queryName("merged").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = rows(spark.sql("SELECT start_ms, end_ms FROM merged"))
    assert (0, 20) in got or {(0, 10), (8, 20)} & set(got)
    assert (50, 60) in got
