import json
import os

from pyspark.sql import functions as F

from tidewell.streaming.windows import event_rates, unwrap_stream


def test_windows_over_a_stream(spark):
    s = spark.readStream.schema("user_id long, ts timestamp_ntz, value double").parquet("/root/testdata/sf0.001/events.parquet*")
    q = event_rates(s.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"]).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    try:
        q.processAllAvailable()
        rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
        assert spark.sql("select sum(n_events) from rates").first()[0] == 2 * rows  # two windows hold each event
    finally:
        q.stop()


def test_rollover_across_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i, part in enumerate(([4294967000, 4294967200], [100, 300])):
        (src / f"{i}.json").write_text("\n".join(json.dumps({"k": 1, "raw": x}) for x in part))
        os.utime(src / f"{i}.json", (1_700_000_000 + 60 * i,) * 2)  # files come in the order of their times
    s = spark.readStream.schema("k int, raw long").option("maxFilesPerTrigger", 1).json(str(src))
    q = unwrap_stream(s, "k").writeStream.format("memory").queryName("turns").outputMode("append").start()
    try:
        q.processAllAvailable()
        assert [r[0] for r in spark.sql("select unwrapped from turns order by unwrapped").collect()] == [4294967000.0, 4294967200.0, 4294967396.0, 4294967596.0]
    finally:
        q.stop()
