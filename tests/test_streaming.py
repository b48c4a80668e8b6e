"""The streaming window statistics equal the batch operator on the same rows."""
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from nightjar.operators import sensors as Z
from nightjar.plans import bindings as B
from nightjar.streaming import stream_window_stats


def test_stream_windows_equal_batch(spark):
    events = B.table(spark, SF_SMALL, "events")
    base = B.sensor_base(events).withColumn("ts", F.timestamp_seconds(F.col("time_s")))
    path = tempfile.mkdtemp(prefix="nightjar-stream-src-")
    base.write.mode("overwrite").parquet(path)
    stream = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = (stream_window_stats(stream, "ts", ["x"], 21600, "acc_", ["dataset_name", "subject_id"],
                             watermark="3650 days")
         .writeStream.outputMode("complete").format("memory").queryName("nightjar_stream_test").start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM nightjar_stream_test")
    want = Z.tumbling_window_stats(base, ["x"], 21600.0, "acc_")
    cols = sorted(want.columns)

    def rows(df):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                      for r in df.select(*cols).collect())
    assert rows(got) == rows(want)
