"""Hot blocks, hot regions and hot loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .iterate import components

#: Share of the total frequency to cover, least frequency, frequency that is always hot.
SHARE, LEAST, ALWAYS = 0.95, 16, 256


def hot_blocks(freqs: DataFrame, share: float = SHARE) -> DataFrame:
    """``block, freq`` of hot blocks: by falling frequency (ties by block) until ``share`` of the total is covered, the crossing
    block included, among those above LEAST; and all above ALWAYS.

    Sums run over distinct frequencies, of which there are few, not over blocks: only blocks
    of the frequency where the share is crossed need a rank.
    """
    per = freqs.groupBy("freq").agg((F.col("freq") * F.count("*")).alias("sum"))
    # One row a distinct frequency: at most the square root of twice the total.
    everything = W.partitionBy(F.lit(0))
    before = F.sum("sum").over(everything.orderBy(F.desc("freq")).rowsBetween(W.unboundedPreceding, -1))
    per = per.select("freq", F.coalesce(before, F.lit(0)).alias("before"), "sum", (F.sum("sum").over(everything) * share).alias("target"))
    known = freqs.join(per, "freq")
    whole = known.where((F.col("before") + F.col("sum") - F.col("freq") < F.col("target")) & (F.col("freq") > LEAST) | (F.col("freq") > ALWAYS))
    crossing = known.where((F.col("before") < F.col("target")) & (F.col("before") + F.col("sum") - F.col("freq") >= F.col("target")) & (F.col("freq") > LEAST) & (F.col("freq") <= ALWAYS))
    rank = F.row_number().over(W.partitionBy("freq").orderBy("block")) - 1
    part = crossing.withColumn("rank", rank).where(F.col("before") + F.col("rank") * F.col("freq") < F.col("target"))
    return whole.select("block", "freq").unionByName(part.select("block", "freq"))


def hot_regions(hot: DataFrame, edges: DataFrame) -> DataFrame:
    """``block, region``: hot blocks joined by edges between them; a region is named by its least block."""
    ids = hot.select(F.col("block").alias("id"))
    inner = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "snk"), "snk", "left_semi")
    return components(ids, inner.select(F.col("src").alias("a"), F.col("snk").alias("b"))).select(F.col("id").alias("block"), F.col("root").alias("region"))


def hot_loops(regions: DataFrame, loops: DataFrame) -> DataFrame:
    """``loop, region, blocks``: each static loop (``loop, block``) united with the least region it meets."""
    meets = loops.join(regions, "block").groupBy("loop").agg(F.min("region").alias("region"))
    mine = meets.join(loops, "loop").select("loop", "region", "block")
    theirs = meets.join(regions, "region").select("loop", "region", "block")
    return mine.unionByName(theirs).groupBy("loop", "region").agg(F.array_sort(F.collect_set("block")).alias("blocks"))
