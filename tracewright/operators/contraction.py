"""Contractions of a weighted graph, one round after the other, with a log from which each can be undone.

A round puts disjoint sets of nodes together, each under a parent of a new name. The log keeps a row for each child, so it is a forest over
the original nodes; with the original edges it says what the graph looks like when any of the parents are opened again.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .counts import weights
from .iterate import spread, tidy
from .iterate import stored as settled

LOG = "round int, kind string, child string, parent string, entry boolean, entrances long, exits long, prob double"


@dataclass(frozen=True)
class Contracted:
    """``original`` and ``edges`` have ``src, snk, freq`` (node names are text); ``edges`` may have more columns that depend on the ends alone."""

    original: DataFrame
    edges: DataFrame
    rounds: int = 0
    #: Rows of the log by rounds; ``n`` is 1, or the size of the pack that ``child`` stands for.
    parts: tuple[DataFrame, ...] = ()
    #: ``name, id, f_in, f_out`` of packed nodes, see ``packed``.
    twins: DataFrame | None = None

    @property
    def log(self) -> DataFrame:
        """``round, kind, child, parent, entry``: a row for each node that went into a parent; kernels have ``entrances, exits, prob`` too."""
        out = self.original.sparkSession.createDataFrame([], LOG)
        for part in self.parts:
            out = out.unionByName(part.where("n = 1").drop("n"), allowMissingColumns=True)
            if self.twins is not None:
                of = self.twins.select(F.col("name").alias("child"), "id")
                out = out.unionByName(part.where("n > 1").join(of, "child").drop("child", "n").withColumnRenamed("id", "child"), allowMissingColumns=True)
        return out

    @property
    def weighted(self) -> DataFrame:
        return weights(self.edges.select("src", "snk", "freq"))


def begin(edges: DataFrame) -> Contracted:
    """No contraction yet; ``edges(src, snk, freq)``, parallel ones are added up."""
    text = edges.select(F.col("src").cast("string").alias("src"), F.col("snk").cast("string").alias("snk"), "freq")
    first = settled(text.groupBy("src", "snk").agg(F.sum("freq").alias("freq")))
    return Contracted(first, first)


@tidy
def put_together(now: Contracted, sets: DataFrame, kind: str, *more: str) -> Contracted:
    """The graph after the disjoint ``sets(id, name, entry)`` (already checkpointed) became a parent ``name@round`` each.

    Inner edges go, but those into a set's entry node (at most one has ``entry``) become a loop of the parent: they close a loop that the
    set lies on. Parallel edges add up.
    """
    made = now.rounds + 1
    n = F.col("n") if "n" in sets.columns else F.lit(1).cast("long")
    part = sets.select(F.lit(made).alias("round"), F.lit(kind).alias("kind"), F.col("id").alias("child"), F.concat(F.col("name"), F.lit(f"@{made}")).alias("parent"), "entry", n.alias("n"), *more)
    end = lambda c: part.select(F.col("child").alias(c), F.col("parent").alias(f"_{c}"), F.col("entry").alias(f"_{c}_entry"))
    moved = now.edges.join(end("src"), "src", "left").join(end("snk"), "snk", "left")
    inner = F.coalesce(F.col("_src") == F.col("_snk"), F.lit(False))
    moved = moved.where(~inner | F.col("_snk_entry"))
    rest = [c for c in now.edges.columns if c not in ("src", "snk", "freq")]
    # A parent is one node, whatever packs are in it.
    moved = moved.withColumns({f"{c}_n": F.when(F.col(f"_{c}").isNull(), F.col(f"{c}_n")).otherwise(1) for c in ("src", "snk") if f"{c}_n" in rest})
    ends = moved.groupBy(F.coalesce("_src", "src").alias("src"), F.coalesce("_snk", "snk").alias("snk"))
    edges = ends.agg(F.sum("freq").alias("freq"), *(F.first(c).alias(c) for c in rest))
    return replace(now, edges=settled(edges), rounds=made, parts=(*now.parts, part))


@tidy
def packed(now: Contracted) -> Contracted:
    """``now`` with nodes of one edge in and one out that share both neighbours, two or more, as one node of the graph, which is named by the least of them.

    ``edges`` then also has ``src_n, snk_n``, the numbers of nodes behind its ends. The log, and the graph once it is ``unpacked``, name the nodes themselves.
    """
    edges = now.edges.select("src", "snk", "freq")
    edges = spread(edges, "src").withColumn("n_out", F.count("*").over(W.partitionBy("src")))
    edges = settled(edges.repartition(-(-now.edges.count() // 400_000), "snk").withColumn("n_in", F.count("*").over(W.partitionBy("snk"))))
    # The way into such a node is its only one, but not its neighbour's only one; the way out likewise.
    into = edges.where("n_in = 1 AND n_out > 1").select(F.col("snk").alias("id"), F.col("src").alias("prev"), F.col("freq").alias("f_in"))
    out = edges.where("n_in > 1 AND n_out = 1").select(F.col("src").alias("id"), F.col("snk").alias("next"), F.col("freq").alias("f_out"))
    same = W.partitionBy("prev", "next")
    near = into.join(out, "id", "full").select("*", F.count("*").over(same).alias("n"), F.min("id").over(same).alias("name"), F.sum("f_in").over(same).alias("all_in"), F.sum("f_out").over(same).alias("all_out"))
    near = settled(near.withColumn("pack", F.coalesce((F.col("n") > 1) & (F.col("prev") != F.col("next")), F.lit(False))))
    one = F.lit(1).cast("long")
    edge = lambda src, snk, freq, a, b: F.struct(F.col(src).alias("src"), F.col(snk).alias("snk"), F.col(freq).alias("freq"), a.alias("src_n"), b.alias("snk_n"))
    n = F.when(F.col("pack"), F.col("n")).otherwise(one)
    first = near.where("NOT pack OR id = name").withColumns({"f_in": F.when(F.col("pack"), F.col("all_in")).otherwise(F.col("f_in")), "f_out": F.when(F.col("pack"), F.col("all_out")).otherwise(F.col("f_out"))})
    around = first.select(F.inline(F.array(edge("prev", "id", "f_in", one, n), edge("id", "next", "f_out", n, one)))).where("src IS NOT NULL AND snk IS NOT NULL")
    others = edges.where("NOT (n_in = 1 AND n_out > 1) AND NOT (n_in > 1 AND n_out = 1)").select("src", "snk", "freq", one.alias("src_n"), one.alias("snk_n"))
    return replace(now, edges=settled(others.unionByName(around)), twins=settled(near.where("pack").select("name", "id", "f_in", "f_out")))


def unpacked(now: Contracted) -> Contracted:
    """``now`` with the nodes that ``packed`` put together, and that lie in no parent since, apart again."""
    plain = now.edges.where("src_n = 1 AND snk_n = 1").select("src", "snk", "freq")
    into = now.edges.where("snk_n > 1").join(now.twins, F.col("snk") == F.col("name")).select("src", F.col("id").alias("snk"), F.col("f_in").alias("freq"))
    out = now.edges.where("src_n > 1").join(now.twins, F.col("src") == F.col("name")).select(F.col("id").alias("src"), "snk", F.col("f_out").alias("freq"))
    return replace(now, edges=settled(plain.unionByName(into).unionByName(out)))


@tidy
def sizes(now: Contracted) -> DataFrame:
    """``top, blocks, least``: of each parent that lies in no other the number of original nodes under it and the least of them. Round by round upwards; no row for each node."""
    up = None
    for part in now.parts:
        rows = part.select("child", "parent", F.col("n").alias("blocks"), F.col("child").alias("least"))
        if up is not None:
            below = up.select(F.col("top").alias("child"), F.col("blocks").alias("_blocks"), F.col("least").alias("_least"))
            rows = rows.join(below, "child", "left").select("child", "parent", F.coalesce("_blocks", "blocks").alias("blocks"), F.coalesce("_least", "least").alias("least"))
            up = up.join(part.select(F.col("child").alias("top")), "top", "left_anti")
        here = rows.groupBy(F.col("parent").alias("top")).agg(F.sum("blocks").alias("blocks"), F.min("least").alias("least"))
        up = settled(here if up is None else up.unionByName(here))
    return now.original.select(F.col("src").alias("top"), F.lit(1).cast("long").alias("blocks"), F.col("src").alias("least")).limit(0) if up is None else up


@tidy
def tops(now: Contracted, opened: DataFrame | None = None) -> DataFrame:
    """``id, top`` of every original node: the highest parent that holds it, below all parents in ``opened(id)``; itself if there is none.

    By pointer jumping up the forest: rounds are logarithmic in its height.
    """
    forest = now.log.select("child", "parent")
    if opened is not None:
        forest = forest.join(opened.select(F.col("id").alias("parent")).distinct(), "parent", "left_anti")
    up = settled(forest)
    while True:
        over = up.select(F.col("child").alias("parent"), F.col("parent").alias("next"))
        nxt = settled(up.join(over, "parent", "left").select("child", F.coalesce("next", "parent").alias("parent"), F.col("next").isNotNull().alias("moved")))
        up = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            break
    ids = now.original.select(F.explode(F.array("src", "snk")).alias("id")).distinct()
    return ids.join(up, F.col("id") == F.col("child"), "left").select("id", F.coalesce("parent", "id").alias("top"))


def with_ancestors(now: Contracted, chosen: DataFrame) -> DataFrame:
    """``id`` of the chosen parents and of all that they lie in."""
    forest = settled(now.log.select("child", "parent"))
    seen = fresh = settled(chosen.select("id").distinct())
    while True:
        above = forest.join(fresh, F.col("child") == F.col("id")).select(F.col("parent").alias("id")).distinct()
        fresh = settled(above.join(seen, "id", "left_anti"))
        if fresh.isEmpty():
            return seen
        seen = settled(seen.unionByName(fresh))


def opened(now: Contracted, chosen: DataFrame) -> DataFrame:
    """``src, snk, freq, weight`` with ``chosen(id)``, and what they lie in, contracted no more; original frequencies."""
    wide = with_ancestors(now, chosen)
    top = settled(tops(now, wide))
    below = settled(tops(now, wide.unionByName(top.select(F.col("top").alias("id"))).distinct()))
    of = top.join(below.withColumnRenamed("top", "below"), "id")
    entry = now.log.where("entry").select(F.col("child").alias("_below"), F.lit(True).alias("into_entry"))
    end = lambda c: of.select(F.col("id").alias(c), F.col("top").alias(f"{c}_top"), F.col("below").alias(f"{c}_below"))
    moved = now.original.join(end("src"), "src").join(end("snk"), "snk").join(entry, F.col("snk_below") == F.col("_below"), "left")
    apart, loop = F.col("src_top") != F.col("snk_top"), F.col("src") == F.col("src_top")
    closes = F.col("into_entry") & (F.col("src_below") != F.col("snk_below"))
    kept = moved.where(apart | loop | F.coalesce(closes, F.lit(False)))
    return weights(kept.groupBy(F.col("src_top").alias("src"), F.col("snk_top").alias("snk")).agg(F.sum("freq").alias("freq")))


def expanded(now: Contracted) -> DataFrame:
    """The original graph again: ``opened`` for every parent of the log. No node lies in a closed one then, so each original edge stands for itself."""
    return weights(now.original.select("src", "snk", "freq"))


def expanded_to(now: Contracted, kind: str = "kernel") -> DataFrame:
    """Opened until the topmost parents of a kind show: what lies in none of them is opened."""
    parents = settled(now.log.select(F.col("parent").alias("id"), "kind").distinct())
    inside, fresh = None, parents.where(F.col("kind") == kind).select("id")
    forest = settled(now.log.select("child", "parent"))
    while True:
        inside = settled(fresh if inside is None else inside.unionByName(fresh))
        down = forest.join(fresh.select(F.col("id").alias("parent")), "parent").select(F.col("child").alias("id")).distinct()
        fresh = settled(down.join(inside, "id", "left_anti"))
        if fresh.isEmpty():
            break
    return opened(now, parents.join(inside, "id", "left_anti"))


def underlying(now: Contracted, edges: DataFrame) -> DataFrame:
    """``src, snk, block_src, block_snk, freq``: the original edges between the nodes that each of ``edges(src, snk)`` joins."""
    top = settled(tops(now))
    end = lambda c: top.select(F.col("id").alias(f"block_{c}"), F.col("top").alias(c))
    blocks = now.original.select(F.col("src").alias("block_src"), F.col("snk").alias("block_snk"), "freq")
    return blocks.join(end("src"), "block_src").join(end("snk"), "block_snk").join(edges.select("src", "snk").distinct(), ["src", "snk"], "left_semi").select("src", "snk", "block_src", "block_snk", "freq")


def leaves(now: Contracted) -> DataFrame:
    """``parent, id``: the original nodes under every parent, which are a row for each level that they lie in."""
    forest = settled(now.log.select("child", "parent"))
    inner = forest.select(F.col("parent").alias("child")).distinct()
    fresh = settled(forest.join(inner, "child", "left_anti").select("parent", F.col("child").alias("id")))
    out = fresh
    while True:
        fresh = settled(fresh.withColumnRenamed("parent", "child").join(forest, "child").select("parent", "id"))
        if fresh.isEmpty():
            return out
        out = settled(out.unionByName(fresh))
