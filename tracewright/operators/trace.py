"""From an ordered trace to transitions. A trace has ``thread, ts, seq, block``; order is (ts, seq) within a thread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import running


def _ordered(*by: str):
    return W.partitionBy(*by).orderBy("ts", "seq")


def transitions(trace: DataFrame, launchers: DataFrame | None = None, bucket_seconds: int | None = None) -> DataFrame:
    """The trace with ``src``, the block before, and ``snk``; rows without a block before are left out.

    ``launchers(thread, launcher)`` gives the block that started a thread, the source of its
    first transition. ``bucket_seconds`` splits each thread by time, so that one hot thread is
    sorted by many tasks: a bucket's first row takes its source from a small table of last blocks.
    """
    if bucket_seconds is None:
        out = trace.withColumn("src", F.lag("block").over(_ordered("thread")))
    else:
        cut = trace.withColumn("bucket", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / bucket_seconds))
        inside = cut.withColumn("src", F.lag("block").over(_ordered("thread", "bucket")))
        last = cut.groupBy("thread", "bucket").agg(F.max_by("block", F.struct("ts", "seq")).alias("last"))
        before = last.withColumn("carried", F.lag("last").over(W.partitionBy("thread").orderBy("bucket"))).select("thread", "bucket", "carried")
        out = inside.join(before, ["thread", "bucket"]).withColumn("src", F.coalesce("src", "carried")).drop("bucket", "carried")
    if launchers is not None:
        out = out.join(launchers, "thread", "left").withColumn("src", F.coalesce("src", "launcher")).drop("launcher")
    return out.where(F.col("src").isNotNull()).withColumn("snk", F.col("block"))


def thread_entries(trace: DataFrame) -> DataFrame:
    """``thread, block``: where each thread starts; one partial aggregate, no sort."""
    return trace.groupBy("thread").agg(F.min_by("block", F.struct("ts", "seq")).alias("block"))


def thread_exits(trace: DataFrame) -> DataFrame:
    return trace.groupBy("thread").agg(F.max_by("block", F.struct("ts", "seq")).alias("block"))


def states(trace: DataFrame, order: int, bucket_seconds: int | None = None) -> DataFrame:
    """``state, snk``: the last ``order`` blocks before each row that has as many, and the row's block.

    With ``bucket_seconds`` each step back takes the one before it from the row before, so a thread is sorted in parts."""
    if bucket_seconds is None:
        w = _ordered("thread")
        rows = trace.select("*", *(F.lag("block", k).over(w).alias(f"_b{k}") for k in range(1, order + 1)))
    else:
        rows = trace
        for k in range(1, order + 1):
            rows = running.previous(rows, f"_b{k - 1}" if k > 1 else "block", f"_b{k}", bucket_seconds=bucket_seconds)
    back = F.array(*(f"_b{k}" for k in range(order, 0, -1)))
    return rows.select(back.alias("state"), F.col("block").alias("snk")).where(~F.exists("state", lambda x: x.isNull()))


def active_labels(trace: DataFrame, bucket_seconds: int | None = None) -> DataFrame:
    """The trace with ``active``, the top of the label stack; rows with ``push`` (a label) enter, rows with ``pop`` leave.

    The depth is a running sum; the last push that reached the present depth is the top. ``bucket_seconds`` as in ``running``.
    """
    step = F.when(F.col("push").isNotNull(), 1).when(F.col("pop"), -1).otherwise(0)
    deep = running.total(trace, step, "depth", bucket_seconds=bucket_seconds)
    pushed = F.when(F.col("push").isNotNull(), F.struct("ts", "seq", "push"))
    top = running.peak(deep, pushed, "_top", keys=("thread", "depth"), bucket_seconds=bucket_seconds)
    return top.withColumn("active", F.when(F.col("depth") > 0, F.col("_top.push"))).drop("_top")
