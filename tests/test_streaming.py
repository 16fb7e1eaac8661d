"""The live form finds the segments that the batch form closes."""

import random

from pyspark.sql import functions as F

from auralake.operators.islands import voice_activity
from auralake.streaming.live import voice_activity_stream


def test_stream_like_batch(spark, tmp_path):
    r = random.Random(1)
    rows = [(f, i, r.choice((0.1, 0.9)) if r.random() < 0.3 else 0.8 if i // 12 % 2 else 0.1) for f in range(4) for i in range(90)]
    df = spark.createDataFrame(rows + [(f, 90, None) for f in range(4)], "file long, i long, p double")
    for k in range(3):
        df.where((F.col("i") >= 30 * k) & (F.col("i") < 30 * k + 31 * (k == 2) + 30 * (k < 2))).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = voice_activity_stream(stream).writeStream.format("memory").queryName("vad").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {tuple(x) for x in spark.table("vad").select("file", "first", "last", "closed").collect()}
    want = {(x.file, x.first, x.last, x.closed) for x in voice_activity(df.where("p is not null")).collect()}
    assert got == want and {x[3] for x in want} == {True, False}
