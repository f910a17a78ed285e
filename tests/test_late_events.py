"""Transitions in event time from files in any order, against the batch form."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tracewright import streaming


def test_mixed_files(spark, tmp_path):
    r = random.Random(3)
    # Equal times, times within one millisecond, and a thread of one event.
    rows = [(r.randrange(3), 10**15 + r.randrange(40) * 400, i, r.choice("abc")) for i in range(120)] + [(9, 10**15 + 5, 500, "a")]
    want, by = Counter(), {}
    for t, us, seq, b in sorted(rows):
        by.setdefault(t, []).append(b)
    for t, blocks in by.items():
        epoch = 0
        for a, b in zip(blocks, blocks[1:]):
            epoch += (a, b) == ("a", "b")
            want[t, a, b, epoch] += 1
    r.shuffle(rows)
    schema = "thread long, us long, seq long, block string"
    stamped = lambda part: spark.createDataFrame(part, schema).select("thread", F.timestamp_micros("us").alias("ts"), "seq", "block").coalesce(1)
    for i in range(3):
        stamped(rows[i::3]).write.mode("append").parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for _ in range(2):
            raw = spark.readStream.schema(stamped(rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            moves = streaming.ordered_transitions(raw, "1 second", frozenset({("a", "b")}))
            moves.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
            stamped([(-1, 10**15 + 10**7, -1, "end"), (None, 10**15, 0, "a"), (1, None, 0, "a")]).write.mode("append").parquet(f"{tmp_path}/in")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert Counter(tuple(x) for x in spark.read.parquet(f"{tmp_path}/out").select("thread", "src", "snk", "epoch").collect()) == want
