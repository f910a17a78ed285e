"""Construction and enrichment of the transition graph.

``edges(src, snk, freq, weight, kind)`` with one row per ordered pair, ``nodes(id)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .counts import weights

ENTRY, EXIT = "<entry>", "<exit>"


class Graph:
    """Edges and nodes together; every method gives a new graph or a DataFrame."""

    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None):
        self.edges = edges
        self.nodes = nodes if nodes is not None else edges.select(F.explode(F.array("src", "snk")).alias("id")).distinct()

    def without_nodes(self, gone: DataFrame) -> Graph:
        ids = gone.select("id")
        kept = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "snk"), "snk", "left_anti")
        return Graph(kept, self.nodes.join(ids, "id", "left_anti"))

    def without_edges(self, gone: DataFrame) -> Graph:
        return Graph(self.edges.join(gone.select("src", "snk"), ["src", "snk"], "left_anti"), self.nodes)

    def with_edges(self, more: DataFrame) -> Graph:
        edges = self.edges.unionByName(more, allowMissingColumns=True)
        return Graph(edges, self.nodes.unionByName(more.select(F.explode(F.array("src", "snk")).alias("id"))).distinct())

    def successors(self) -> DataFrame:
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("snk")).alias("successors"))

    def predecessors(self) -> DataFrame:
        return self.edges.groupBy(F.col("snk").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("predecessors"))

    def first_nodes(self) -> DataFrame:
        return self.nodes.join(self.edges.select(F.col("snk").alias("id")), "id", "left_anti")

    def last_nodes(self) -> DataFrame:
        return self.nodes.join(self.edges.select(F.col("src").alias("id")), "id", "left_anti")


def typed(edges: DataFrame, static: DataFrame | None = None) -> DataFrame:
    """``edges`` with ``kind`` and ``weight``: conditional where the source has more than one observed target
    (``static(src, snk, kind)`` may name call and return edges), else unconditional with weight 1."""
    out = edges.groupBy("src", "snk").agg(F.sum("freq").alias("freq"))
    degree = out.groupBy("src").agg(F.count("*").alias("_out"))
    out = out.join(degree, "src")
    if static is not None:
        out = out.join(static.select("src", "snk", F.col("kind").alias("_kind")).distinct(), ["src", "snk"], "left")
    else:
        out = out.withColumn("_kind", F.lit(None).cast("string"))
    special = F.when(F.col("_kind").isin("call", "return"), F.col("_kind"))
    kind = F.coalesce(special, F.when(F.col("_out") > 1, F.lit("conditional")).otherwise("unconditional"))
    named = weights(out.withColumn("kind", kind).drop("_out", "_kind"))
    return named.withColumn("weight", F.when(F.col("kind") == "unconditional", F.lit(1.0)).otherwise(F.col("weight")))


def renormalise(edges: DataFrame) -> DataFrame:
    return weights(edges.drop("weight"))


def resolve_indirect(calls: DataFrame, callers: DataFrame, functions: DataFrame) -> DataFrame:
    """``block, callee``: static targets of call sites, or for null ones the functions observed to be entered from the block."""
    seen = callers.join(functions.select(F.col("block").alias("snk"), "fn"), "snk").select(F.col("src").alias("block"), F.col("fn").alias("seen"))
    return calls.join(seen, "block", "left").select("block", F.coalesce("callee", "seen").alias("callee")).where("callee IS NOT NULL").distinct()


def return_edges(edges: DataFrame, functions: DataFrame, entries: DataFrame) -> DataFrame:
    """``edges`` whose ends lie in different functions, the sink not being a function entry, become returns; weights renormalised."""
    fn = functions.select("block", "fn")
    both = edges.join(fn.select(F.col("block").alias("src"), F.col("fn").alias("_sf")), "src", "left").join(fn.select(F.col("block").alias("snk"), F.col("fn").alias("_kf")), "snk", "left")
    both = both.join(entries.select(F.col("block").alias("snk"), F.lit(True).alias("_entry")), "snk", "left")
    back = (F.col("_sf") != F.col("_kf")) & F.col("_entry").isNull()
    return renormalise(both.withColumn("kind", F.when(back, "return").otherwise(F.col("kind"))).drop("_sf", "_kf", "_entry"))


def patch_entries(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Every edge from elsewhere into a function entry is a call."""
    marked = edges.join(entries.select(F.col("block").alias("snk"), F.lit(True).alias("_entry")).distinct(), "snk", "left")
    return marked.withColumn("kind", F.when(F.col("_entry") & (F.col("kind") != "imaginary"), "call").otherwise(F.col("kind"))).drop("_entry")


def add_sentinels(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges from ENTRY to the blocks that threads start with, and from those they end with to EXIT; each counts its threads."""
    into = starts.groupBy(F.col("block").alias("snk")).agg(F.count("*").alias("freq")).select(F.lit(ENTRY).alias("src"), "snk", "freq")
    out = ends.groupBy(F.col("block").alias("src")).agg(F.count("*").alias("freq")).select("src", F.lit(EXIT).alias("snk"), "freq")
    return edges.select("src", "snk", "freq").unionByName(into).unionByName(out)


def entry_node(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") == ENTRY).select(F.col("snk").alias("id"))


def terminators(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("snk") == EXIT).select(F.col("src").alias("id"))


def without_tail_head_calls(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """Drops call edges from a returning block of a function to that function's entry, unless it is recursive; renormalises.

    ``functions(block, fn, is_entry, returns, recursive)``.
    """
    tails = functions.where("returns AND NOT recursive").select(F.col("block").alias("src"), "fn")
    heads = functions.where("is_entry").select(F.col("block").alias("snk"), "fn")
    fake = tails.join(heads, "fn").select("src", "snk").withColumn("kind", F.lit("call"))
    return renormalise(edges.join(fake, ["src", "snk", "kind"], "left_anti"))


def call_graph(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """``caller, callee, sites, calls`` from ``calls(src, snk, calls)``, the observed entries, and ``functions(block, fn)``."""
    fn = functions.select("block", "fn")
    named = calls.join(fn.select(F.col("block").alias("src"), F.col("fn").alias("caller")), "src").join(fn.select(F.col("block").alias("snk"), F.col("fn").alias("callee")), "snk")
    return named.groupBy("caller", "callee").agg(F.array_sort(F.collect_set("src")).alias("sites"), F.sum("calls").alias("calls"))


def live_functions(functions: DataFrame, freqs: DataFrame) -> DataFrame:
    """Functions whose entry was observed."""
    return functions.where("is_entry").join(freqs.select("block"), "block", "left_semi").select("fn").distinct()


def unconventional_exits(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """``fn, block``: blocks that leave to EXIT from a function that isn't the one of the entry block."""
    main = entry_node(edges).join(functions.select(F.col("block").alias("id"), "fn"), "id").select("fn")
    return terminators(edges).join(functions.select(F.col("block").alias("id"), "fn"), "id").join(main, "fn", "left_anti").select("fn", F.col("id").alias("block"))


def coverage(static: DataFrame, observed: DataFrame) -> DataFrame:
    """``static`` edges with ``is_covered``."""
    seen = observed.select("src", "snk", F.lit(True).alias("is_covered")).distinct()
    return static.join(seen, ["src", "snk"], "left").withColumn("is_covered", F.coalesce("is_covered", F.lit(False)))


def static_call_graph(static: DataFrame, observed: DataFrame) -> DataFrame:
    """``caller, callees``: static targets and those seen through pointers."""
    both = static.select("caller", "callee").unionByName(observed.select("caller", "callee")).where("callee IS NOT NULL")
    return both.groupBy("caller").agg(F.array_sort(F.collect_set("callee")).alias("callees"))


def def_use(instructions: DataFrame, operands: DataFrame) -> DataFrame:
    """``src, snk``: value to user, of values and users in ``instructions(inst)``; each once."""
    known = instructions.select("inst")
    return operands.select(F.col("operand").alias("src"), F.col("user").alias("snk")).join(known.withColumnRenamed("inst", "src"), "src", "left_semi").join(known.withColumnRenamed("inst", "snk"), "snk", "left_semi").distinct()


def block_members(supernodes: DataFrame) -> DataFrame:
    """``block, node``: the outermost supernode of each block, from ``supernodes(parent, child)``; plain blocks lead to themselves."""
    from .paths import closure

    above = closure(supernodes.select(F.col("child").alias("src"), F.col("parent").alias("snk")))
    tops = above.join(supernodes.select(F.col("child").alias("snk")).distinct(), "snk", "left_anti").select(F.col("src").alias("block"), F.col("snk").alias("node"))
    return tops.join(supernodes.select(F.col("parent").alias("block")).distinct(), "block", "left_anti")
