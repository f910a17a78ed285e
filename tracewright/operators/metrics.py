"""Measures of a weighted transition graph ``src, snk, freq, weight``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions import surprise

from . import running


def total_entropy(edges: DataFrame) -> DataFrame:
    """``total_entropy``: -sum of w log2 w over all edges."""
    return edges.agg((-F.sum(surprise(F.col("weight")))).alias("total_entropy"))


def entropy_rate(edges: DataFrame) -> DataFrame:
    """``entropy_rate``: node entropies weighted by each node's share of incoming frequency."""
    own = edges.groupBy(F.col("src").alias("node")).agg((-F.sum(surprise(F.col("weight")))).alias("h"))
    into = edges.groupBy(F.col("snk").alias("node")).agg(F.sum("freq").alias("f"))
    return into.join(own, "node", "left").agg((F.sum(F.col("f") * F.coalesce("h", F.lit(0.0))) / F.sum("f")).alias("entropy_rate"))


def stationary(edges: DataFrame, steps: int = 50, tolerance: float = 1e-9, damping: float = 0.5) -> DataFrame:
    """``node, p``: the chain's stationary distribution by lazy power iteration (mass of sinks is spread over all nodes)."""
    from .iterate import checkpoint

    nodes = checkpoint(edges.select(F.explode(F.array("src", "snk")).alias("node")).distinct())
    n = nodes.count()
    p = nodes.withColumn("p", F.lit(1.0 / n))
    for k in range(steps):
        moved = p.join(edges, p["node"] == edges["src"]).groupBy(F.col("snk").alias("node")).agg(F.sum(F.col("p") * F.col("weight")).alias("q"))
        step = nodes.join(moved, "node", "left").join(p, "node").select("node", "p", F.coalesce("q", F.lit(0.0)).alias("q"))
        kept = step.agg(F.sum("q")).first()[0] or 0.0
        nxt = step.select("node", "p", (F.col("p") * damping + (F.col("q") + (1 - kept) / n) * (1 - damping)).alias("next"))
        nxt = checkpoint(nxt)
        change = nxt.agg(F.sum(F.abs(F.col("next") - F.col("p")))).first()[0]
        p = nxt.select("node", F.col("next").alias("p"))
        if change < tolerance:
            break
    return p


def graph_size(edges: DataFrame) -> DataFrame:
    """``nodes, edges``."""
    ends = edges.select(F.explode(F.array("src", "snk")).alias("node")).agg(F.count_distinct("node").alias("nodes")).withColumn("k", F.lit(0))
    return ends.join(edges.agg(F.count("*").alias("edges")).withColumn("k", F.lit(0)), "k").drop("k")


def high_water(samples: DataFrame, bucket_seconds: int | None = None) -> DataFrame:
    """``samples(thread, ts, seq, bytes)`` with ``high_water``, the most bytes so far; ``bucket_seconds`` as in ``running``."""
    return running.peak(samples, F.col("bytes"), "high_water", bucket_seconds=bucket_seconds)


def weight_sums(edges: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """``src, total, ok``: outgoing weights that should sum to one."""
    return edges.groupBy("src").agg(F.sum("weight").alias("total")).withColumn("ok", F.abs(F.col("total") - 1) <= tolerance)


def instruction_profile(instructions: DataFrame, frequencies: DataFrame) -> DataFrame:
    """``kernel, op, type, n, weighted``: instruction counts by opcode, by type and by both, static and by block frequency."""
    rows = instructions.join(frequencies, "block", "left").withColumn("f", F.coalesce("freq", F.lit(0)))
    sets = rows.groupingSets([["kernel", "op"], ["kernel", "type"], ["kernel", "op", "type"]], "kernel", "op", "type")
    return sets.agg(F.count("*").alias("n"), F.sum("f").alias("weighted"))
