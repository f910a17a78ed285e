"""Counting: edges, callers, labels, block frequencies, weights, Markov order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_counts(moves: DataFrame) -> DataFrame:
    """``src, snk, freq``; partial and final hash aggregation."""
    return moves.groupBy("src", "snk").agg(F.count("*").alias("freq"))


def caller_counts(moves: DataFrame) -> DataFrame:
    """``src, snk, calls`` of transitions that enter a function (``is_entry``)."""
    return moves.where("is_entry").groupBy("src", "snk").agg(F.count("*").alias("calls"))


def label_counts(labelled: DataFrame) -> DataFrame:
    """``block, label, votes`` from rows with an active label."""
    return labelled.where("active IS NOT NULL").groupBy("block", F.col("active").alias("label")).agg(F.count("*").alias("votes"))


def block_frequency(edges: DataFrame) -> DataFrame:
    """``block, freq``: the sum over incoming edges."""
    return edges.groupBy(F.col("snk").alias("block")).agg(F.sum("freq").alias("freq"))


def weights(edges: DataFrame) -> DataFrame:
    """``edges`` with ``weight = freq / sum of the source's freq``; sums are partial aggregates, so a hub's edges are never held together."""
    total = edges.groupBy(F.col("src").alias("_of")).agg(F.sum("freq").alias("_total"))
    return edges.join(total, F.col("src") == F.col("_of")).withColumn("weight", F.col("freq") / F.col("_total")).drop("_of", "_total")


def order_counts(states: DataFrame) -> DataFrame:
    """``state, snk, freq`` of an order-N chain."""
    return states.groupBy("state", "snk").agg(F.count("*").alias("freq"))


def reduce_order(chain: DataFrame) -> DataFrame:
    """Order N to N - 1: the oldest block of each state is summed out."""
    return chain.groupBy(F.slice("state", 2, F.size("state")).alias("state"), "snk").agg(F.sum("freq").alias("freq"))


def lookup(edges: DataFrame, src, snk) -> DataFrame:
    return edges.where((F.col("src") == src) & (F.col("snk") == snk))


def upsert(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """``edges`` with the rows of ``changes`` put in place of those of the same ends."""
    both = edges.withColumn("_v", F.lit(0)).unionByName(changes.withColumn("_v", F.lit(1)))
    return both.groupBy("src", "snk").agg(F.max_by("freq", "_v").alias("freq"))


def bucket_statistics(edges: DataFrame, buckets: int = 1024) -> DataFrame:
    """``nodes, edges, live_buckets, fullest``: size and occupancy of the table hashed into buckets."""
    ends = edges.select(F.explode(F.array("src", "snk")).alias("node"))
    per = edges.groupBy(F.pmod(F.xxhash64("src", "snk"), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"))
    nodes = ends.agg(F.count_distinct("node").alias("nodes")).withColumn("k", F.lit(0))
    full = per.agg(F.sum("n").alias("edges"), F.count("*").alias("live_buckets"), F.max("n").alias("fullest")).withColumn("k", F.lit(0))
    return nodes.join(full, "k").drop("k")
