"""Segmentation into kernels: likeliest cycles, chosen, contracted and nested until none is left."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import paths, regions
from .contraction import Contracted, begin, leaves, put_together
from .iterate import settled
from .rewrite import ANCHOR

#: Fixed value: children from which a kernel of kernels is kept in any case.
MANY_CHILDREN = 5


def candidates(edges: DataFrame) -> DataFrame:
    """``name, id, entrances, exits, prob, least``: likeliest cycles worth a kernel, once each, named by the first node that they are the best of.

    Worth one: no other cycle among its nodes besides those through the node that it is the best of, entered and left, one node
    entered ``ANCHOR`` times. ``edges(src, snk, freq)``; with a column ``inside``, only edges that have it are walked. Probability is the product around the cycle.
    """
    cycles, found = regions.likeliest_cycles(regions.cycle_edges(edges))
    spots = cycles.select("source", F.col("node"), "at")
    inner = spots.withColumnsRenamed({"node": "src", "at": "from"}).join(edges.select("src", "snk"), "src").join(spots.withColumnsRenamed({"node": "snk", "at": "to"}), ["source", "snk"])
    # Along the cycle an edge to the same place or an earlier one closes another cycle, unless it ends in the source; so does a loop of the source, if there are others.
    other = inner.where("(`to` > 0 AND `to` <= `from`) OR (`to` = 0 AND `from` = 0)").select("source", "to")
    sets = spots.groupBy("source").agg(F.array_sort(F.collect_list("node")).alias("ids"))
    other = other.join(sets.where(F.size("ids") > 1).select("source"), "source", "left_semi").select("source").distinct()
    once = sets.join(other, "source", "left_anti").join(found, "source").groupBy("ids").agg(F.max("prob").alias("prob"), F.min("source").alias("name"))
    flat = settled(once.select("name", "prob", F.col("ids")[0].alias("least"), F.explode("ids").alias("id")))
    good = regions.boundary(edges, flat).where(f"anchor >= {ANCHOR} AND entrances > 0 AND exits > 0").select("name", "entrances", "exits")
    return settled(flat.join(good, "name"))


def kernels(edges: DataFrame, least: bool = False) -> Contracted:
    """The graph ``edges(src, snk, freq)`` rewritten and with its kernels put together, until no cycle is worth one; they are the log's ``kernel`` rows.

    Of candidates that overlap, the one with fewest entrances and exits goes first, then the likeliest, then by name. With ``least``
    a round takes only those with the fewest of all; else all that overlap with no better one.
    """
    now = begin(edges)
    group = settled(paths.strongly_connected(now.edges))
    end = lambda c: group.select(F.col("id").alias(c), F.col("scc").alias(f"_{c}"))
    # Rewriting keeps components together, so the mark stays right.
    marked = now.edges.join(end("src"), "src").join(end("snk"), "snk").select("src", "snk", "freq", (F.col("_src") == F.col("_snk")).alias("inside"))
    now = regions.simplify(replace(now, edges=settled(marked)))
    while True:
        found = candidates(now.edges)
        if least:
            score = F.col("entrances") + F.col("exits")
            found = found.where(score == found.agg(F.min(score)).first()[0])
        if found.isEmpty():
            return now
        chosen = regions.independent(found, F.col("entrances") + F.col("exits"), -F.col("prob"), F.col("least"))
        sets = settled(chosen.select("name", "id", F.lit(False).alias("entry"), "entrances", "exits", "prob"))
        now = regions.simplify(put_together(now, sets, "kernel", "entrances", "exits", "prob"))


def kernel_tree(now: Contracted) -> tuple[DataFrame, DataFrame]:
    """``kernel, entrances, exits, prob, parent`` (the next kernel that holds it, null at the top) and ``kernel, block``, without kernels that only gather others.

    Dropped are top kernels of two to ``MANY_CHILDREN - 1`` children that all have children themselves, again and again.
    """
    log = settled(now.log)
    made = log.where("kind = 'kernel'").groupBy(F.col("parent").alias("kernel")).agg(F.first("entrances").alias("entrances"), F.first("exits").alias("exits"), F.first("prob").alias("prob"))
    # Up from each kernel to the next one.
    forest = log.select("child", "parent", (F.col("kind") == "kernel").alias("is_kernel"))
    walk = settled(made.select("kernel", F.col("kernel").alias("at"), F.lit(False).alias("done")))
    while True:
        up = forest.select(F.col("child").alias("at"), "parent", "is_kernel")
        nxt = walk.join(up, "at", "left").select("kernel", F.when(F.col("done"), F.col("at")).otherwise(F.col("parent")).alias("at"), (F.col("done") | F.coalesce("is_kernel", F.lit(True))).alias("done"))
        walk = settled(nxt)
        if walk.where("NOT done").isEmpty():
            break
    tree = made.join(walk.select("kernel", F.col("at").alias("parent")), "kernel")
    while True:
        tree = settled(tree)
        n = tree.where("parent IS NOT NULL").groupBy(F.col("parent").alias("kernel")).agg(F.count("*").alias("children"))
        grand = tree.join(n, "kernel", "left").groupBy(F.col("parent").alias("kernel")).agg(F.min(F.coalesce("children", F.lit(0))).alias("fewest"))
        gone = tree.where("parent IS NULL").join(n, "kernel").join(grand, "kernel").where(f"children BETWEEN 2 AND {MANY_CHILDREN - 1} AND fewest > 0").select("kernel")
        gone = settled(gone)
        if gone.isEmpty():
            break
        tree = tree.join(gone, "kernel", "left_anti").join(gone.select(F.col("kernel").alias("parent"), F.lit(1).alias("lost")), "parent", "left")
        tree = tree.select("kernel", "entrances", "exits", "prob", F.when(F.col("lost").isNull(), F.col("parent")).alias("parent"))
    blocks = leaves(now).select(F.col("parent").alias("kernel"), F.col("id").alias("block")).join(tree.select("kernel"), "kernel", "left_semi")
    return tree, settled(blocks)


def crossings(now: Contracted, blocks: DataFrame, inward: bool) -> DataFrame:
    """``kernel, ends``: the original edges, as ``a->b``, that enter (or leave) the blocks of each kernel in ``blocks(kernel, block)``."""
    near, far = ("snk", "src") if inward else ("src", "snk")
    own = blocks.select("kernel", F.col("block").alias(far), F.lit(True).alias("inner"))
    over = blocks.join(now.original, F.col("block") == F.col(near)).select("kernel", "src", "snk").join(own, ["kernel", far], "left").where("inner IS NULL")
    return over.groupBy("kernel").agg(F.array_sort(F.collect_set(F.concat_ws("->", "src", "snk"))).alias("ends"))


def table(now: Contracted) -> DataFrame:
    """``kernel int, blocks, children, parents, entrances, exits, probability``; one row a kernel, numbered by round, fewest ends and likeliest first. Entrances and exits are edges of blocks."""
    tree, blocks = kernel_tree(now)
    rounds = now.log.where("kind = 'kernel'").select(F.col("parent").alias("kernel"), "round").distinct()
    order = tree.join(rounds, "kernel")
    # Numbers: kernels of earlier rounds, and the place in the own one.
    before = order.groupBy("round").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("round").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(W.partitionBy("round").orderBy(F.col("entrances") + F.col("exits"), F.desc("prob"), "kernel"))
    named = settled(order.withColumn("place", place).join(before.select("round", "before"), "round").select("kernel", (F.col("before") + F.col("place") - 1).cast("int").alias("number"), "entrances", "exits", "prob", "parent"))
    held = blocks.groupBy("kernel").agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    of = named.select(F.col("kernel").alias("parent"), F.col("number").alias("above"))
    pairs = named.join(of, "parent").select("kernel", "parent", "number", "above")
    below = pairs.groupBy(F.col("parent").alias("kernel")).agg(F.array_sort(F.collect_list("number")).alias("children"))
    above = pairs.groupBy("kernel").agg(F.collect_list("above").alias("parents"))
    into, out = (crossings(now, blocks, inward).withColumnRenamed("ends", c) for inward, c in ((True, "into"), (False, "out")))
    rows = named.join(held, "kernel").join(below, "kernel", "left").join(above, "kernel", "left").join(into, "kernel", "left").join(out, "kernel", "left")
    full = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    lists = [full(c, kind).alias(name) for c, kind, name in (("children", "int", "children"), ("parents", "int", "parents"), ("into", "string", "entrances"), ("out", "string", "exits"))]
    return rows.select(F.col("number").alias("kernel"), "blocks", *lists, F.col("prob").alias("probability"))


def labels(members: DataFrame, votes: DataFrame) -> DataFrame:
    """``kernel, label``: most votes of ``votes(block, label, votes)`` over ``members(kernel, block)``; a block without votes gives one to the empty label."""
    per = members.join(votes, "block", "left").groupBy("kernel", F.coalesce("label", F.lit("")).alias("label")).agg(F.sum(F.coalesce("votes", F.lit(1))).alias("votes"))
    best = F.row_number().over(W.partitionBy("kernel").orderBy(F.desc("votes"), "label"))
    return per.withColumn("rank", best).where("rank = 1").drop("rank")


def exclusive(members: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """``kernel, block`` less the blocks of the kernel's children."""
    inner = hierarchy.join(members.withColumnRenamed("kernel", "child"), "child").select(F.col("parent").alias("kernel"), "block")
    return members.join(inner, ["kernel", "block"], "left_anti")


def outside(blocks: DataFrame, members: DataFrame) -> DataFrame:
    """Blocks under no kernel."""
    return blocks.select("block").distinct().join(members.select("block"), "block", "left_anti")


def average_size(members: DataFrame) -> DataFrame:
    """``avg_blocks``, 0 without kernels."""
    return members.groupBy("kernel").agg(F.count_distinct("block").alias("n")).agg(F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_blocks"))


def preceding(order: DataFrame) -> DataFrame:
    """``kernel, before``: every kernel that a breadth-first walk met earlier, from ``order(kernel, level)``; few rows, one a pair of kernels."""
    other = order.select(F.col("kernel").alias("before"), F.col("level").alias("_l"))
    return order.join(other, F.col("_l") < F.col("level")).select("kernel", "before")


def levels(hierarchy: DataFrame, kernels_: DataFrame) -> DataFrame:
    """``kernel, level``: depth below the top; the longest way down counts."""
    now = settled(kernels_.select("kernel").distinct().withColumn("level", F.lit(0)))
    while True:
        deeper = hierarchy.join(now, F.col("parent") == F.col("kernel")).groupBy("child").agg((F.max("level") + 1).alias("up"))
        nxt = settled(now.join(deeper, F.col("kernel") == F.col("child"), "left").select("kernel", F.coalesce("up", "level").alias("next"), "level"))
        if nxt.where("next <> level").isEmpty():
            return now
        now = nxt.select("kernel", F.col("next").alias("level"))


def distinct_sets(members: DataFrame) -> DataFrame:
    """``kernel``: the least kernel of each set of blocks."""
    sets = members.groupBy("kernel").agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    return sets.groupBy("blocks").agg(F.min("kernel").alias("kernel")).select("kernel")


def block_closure(members: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """``kernel, block`` with the blocks of all descendants."""
    from .paths import closure

    below = closure(hierarchy.select(F.col("parent").alias("src"), F.col("child").alias("snk")))
    inner = below.join(members, F.col("snk") == F.col("kernel")).select(F.col("src").alias("kernel"), "block")
    return members.select("kernel", "block").unionByName(inner).distinct()
