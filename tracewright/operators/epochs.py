"""Epochs: sessions of a trace cut at boundary transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import running

#: Share of an epoch's blocks that must lie in a kernel; frequency above which an epoch is hot.
OVERLAP, HOT = 0.5, 32


def boundaries(kernels: DataFrame) -> DataFrame:
    """``src, snk``: entrances and exits of kernels without parents, from ``kernels(parents, entrances, exits)`` with maps block -> [block]."""
    def ends(name: str) -> DataFrame:
        return kernels.where(F.size(F.coalesce("parents", F.array())) == 0).select(F.explode(name).alias("src", "to")).select("src", F.explode("to").alias("snk"))

    return ends("entrances").unionByName(ends("exits")).distinct()


def assign(trace: DataFrame, edges: DataFrame, bucket_seconds: int | None = None) -> DataFrame:
    """The trace with ``epoch`` (0, 1, ... within a thread), which grows at each transition in ``edges(src, snk)``; ``bucket_seconds`` as in ``running``."""
    marks = edges.select(F.col("src").alias("_src"), F.col("snk").alias("_snk")).distinct()
    moved = running.previous(trace, "block", "before", bucket_seconds=bucket_seconds).join(marks, (F.col("before") == F.col("_src")) & (F.col("block") == F.col("_snk")), "left")
    cut = F.when(F.col("_src").isNotNull(), 1).otherwise(0)
    return running.total(moved, cut, "epoch", bucket_seconds=bucket_seconds).drop("before", "_src", "_snk")


def block_frequency(epochs: DataFrame) -> DataFrame:
    """``thread, epoch, block, freq``."""
    return epochs.groupBy("thread", "epoch", "block").agg(F.count("*").alias("freq"))


def hot_epochs(freqs: DataFrame, least: int = HOT) -> DataFrame:
    """``thread, epoch, max_freq`` of epochs with a block above ``least``."""
    return freqs.groupBy("thread", "epoch").agg(F.max("freq").alias("max_freq")).where(F.col("max_freq") > least)


def sequence(epochs: DataFrame) -> DataFrame:
    """``thread, epoch, next_epoch`` for each epoch that has a successor."""
    own = epochs.select("thread", "epoch").distinct()
    return own.withColumn("next_epoch", F.lead("epoch").over(W.partitionBy("thread").orderBy("epoch"))).where("next_epoch IS NOT NULL")


def match_kernels(freqs: DataFrame, closure: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """``thread, epoch, kernel``: the first kernel (by id) of ``closure(kernel, block)`` that holds more than ``overlap`` of the epoch's blocks."""
    size = freqs.groupBy("thread", "epoch").agg(F.count_distinct("block").alias("size"))
    inside = freqs.select("thread", "epoch", "block").distinct().join(closure.distinct(), "block").groupBy("thread", "epoch", "kernel").agg(F.count("*").alias("n"))
    return inside.join(size, ["thread", "epoch"]).where(F.col("n") / F.col("size") > overlap).groupBy("thread", "epoch").agg(F.min("kernel").alias("kernel"))


def sections(trace: DataFrame, members: DataFrame, bucket_seconds: int | None = None) -> DataFrame:
    """Sections entered, left and continued at each step: ``members(block, section)`` gives the sections of a block."""
    of = members.groupBy("block").agg(F.array_sort(F.collect_set("section")).alias("now"))
    none = F.array().cast(of.schema["now"].dataType)
    rows = trace.join(of, "block", "left").withColumn("now", F.coalesce("now", none))
    rows = running.previous(rows, "now", "was", bucket_seconds=bucket_seconds).withColumn("was", F.coalesce("was", none))
    return rows.select("thread", "ts", "seq", "block", F.array_except("now", "was").alias("entered"), F.array_except("was", "now").alias("left"), F.array_intersect("now", "was").alias("continued"))


def instances(steps: DataFrame, bucket_seconds: int | None = None) -> DataFrame:
    """``section, thread, instance, steps``: uninterrupted stays in a section, numbered within the thread."""
    on = steps.select("thread", "ts", "seq", F.explode(F.concat("entered", "continued")).alias("section"), "entered")
    fresh = F.when(F.array_contains("entered", F.col("section")), 1).otherwise(0)
    return running.total(on, fresh, "instance", keys=("thread", "section"), bucket_seconds=bucket_seconds).groupBy("section", "thread", "instance").agg(F.count("*").alias("steps"))
