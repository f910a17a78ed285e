"""Rewrites of a weighted graph by its regions: chains, branches that meet, regions of one entrance and one exit, rare loops; to a fixpoint.

Each rule looks at all nodes at once and gives sets of nodes; of sets that overlap the best goes first and the others
wait for another round. Rows are bounded by the edges times the size of the largest region (``REGION`` edges).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .contraction import Contracted, packed, put_together, unpacked
from .counts import weights
from .iterate import stored as settled
from .iterate import tidy
from .paths import likeliest_cycles
from .rewrite import ANCHOR, REGION, balance

#: Edges from which on a graph is shrunk with like nodes packed: packing costs some passes over all edges.
PACKED_FROM = 1_000_000


def counted(edges: DataFrame) -> DataFrame:
    """``edges`` with ``n_out`` of their source, ``n_in`` of their sink, and ``src_n, snk_n``, the nodes that their ends stand for (1 unless ``contraction.packed``)."""
    sized = edges if "src_n" in edges.columns else edges.withColumns({"src_n": F.lit(1).cast("long"), "snk_n": F.lit(1).cast("long")})
    n = F.sum(F.col("src_n") * F.col("snk_n"))
    return sized.withColumn("n_out", n.over(W.partitionBy("src"))).withColumn("n_in", n.over(W.partitionBy("snk")))


def degrees(edges: DataFrame) -> DataFrame:
    """``id, n_in, n_out`` of nodes with at least one edge in and one out; a loop counts in both."""
    into = edges.groupBy(F.col("snk").alias("id")).agg(F.count("*").alias("n_in"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
    return into.join(out, "id")


@tidy
def independent(sets: DataFrame, *order: Column) -> DataFrame:
    """Rows of ``sets(name, id, ...)`` of the names that are chosen: in turn the first by ``order`` that shares no id with one chosen before.

    In rounds: a set that is first at all its ids is chosen, what overlaps it goes.
    """
    left = settled(sets.withColumn("_at", F.struct(*order, F.col("name"))))
    chosen = None
    while not left.isEmpty():
        first = left.groupBy("id").agg(F.min("_at").alias("_first"))
        wins = left.join(first, "id").groupBy("name").agg(F.min((F.col("_at") == F.col("_first")).cast("int")).alias("all")).where("all = 1").select("name")
        won = settled(left.join(wins, "name", "left_semi"))
        chosen = won if chosen is None else chosen.unionByName(won)
        hit = left.join(won.select("id"), "id", "left_semi").select("name").distinct()
        left = settled(left.join(hit, "name", "left_anti"))
    return sets.limit(0) if chosen is None else settled(chosen.drop("_at"))


@tidy
def chain_sets(edges: DataFrame) -> DataFrame:
    """``name, id, entry``: maximal chains, named by their first node, which is their entry; of a ring without an entrance the least node.

    A node has one chain edge in and one out at most, so heads are found by pointer jumping, in rounds logarithmic in the longest chain.
    """
    # Over the only way out of a node that is led to, and the only way into one with one way out, but not back.
    every = settled(counted(edges).select("src", "snk", "n_out", "n_in"))
    after = every.where("n_out = 1").select(F.col("src").alias("snk"), F.col("snk").alias("next"))
    links = every.where("n_out = 1 AND n_in = 1").join(after, "snk").where("next <> src").select("src", "snk")
    links = settled(links.join(every.select(F.col("snk").alias("src")), "src", "left_semi"))
    if links.isEmpty():
        return links.select(F.col("src").alias("name"), F.col("src").alias("id"), F.lit(True).alias("entry"))
    # far: the node so many steps back, least: the least node on the way.
    up = links.select(F.col("snk").alias("id"), F.col("src").alias("far"), F.least("src", "snk").alias("least"))
    steps, most = 1, links.count()
    while True:
        over = up.select(F.col("id").alias("far"), F.col("far").alias("next"), F.col("least").alias("low"))
        up = settled(up.join(over, "far", "left").select("id", F.coalesce("next", "far").alias("far"), F.least("least", F.coalesce("low", "least")).alias("least"), F.col("next").isNotNull().alias("moved")))
        steps *= 2
        if steps > most or up.where("moved").isEmpty():
            break
        up = up.drop("moved")
    # In a ring every node still has one before it.
    named = up.select("id", F.when(F.col("moved"), F.col("least")).otherwise(F.col("far")).alias("name"))
    heads = named.select(F.col("name").alias("id"), "name")
    return settled(named.unionByName(heads).distinct().select("name", "id", (F.col("name") == F.col("id")).alias("entry")))


@tidy
def diamonds(edges: DataFrame) -> DataFrame:
    """``name, id, entry``: branches whose arms of one node each meet again at once, with or without a direct way; two arms or more.

    Only the branch leads into the arms, only arms (and the branch) lead to the meeting point, which leads on, but not back to the branch; the branch is led to.
    """
    deg = degrees(edges)
    arms = deg.where("n_in = 1 AND n_out = 1").select("id")
    arms = arms.join(edges.select(F.col("snk").alias("id"), F.col("src").alias("s")), "id").join(edges.select(F.col("src").alias("id"), F.col("snk").alias("t")), "id").where("s <> t AND s <> id AND t <> id")
    arms = settled(arms)
    if arms.isEmpty():
        return edges.limit(0).select(F.col("src").alias("name"), F.col("src").alias("id"), F.lit(True).alias("entry"))
    direct = edges.select(F.col("src").alias("s"), F.col("snk").alias("t"), F.lit(1).alias("direct"))
    back = edges.select(F.col("src").alias("t"), F.col("snk").alias("s"))
    met = arms.groupBy("s", "t").agg(F.count("*").alias("n")).join(direct, ["s", "t"], "left").withColumn("n", F.col("n") + F.coalesce("direct", F.lit(0))).where("n >= 2").drop("direct")
    met = met.join(deg.select(F.col("id").alias("s"), "n_out"), "s").join(deg.select(F.col("id").alias("t"), "n_in"), "t").where("n_out = n AND n_in = n").join(back, ["s", "t"], "left_anti")
    met = settled(met.select("s", "t", "n"))
    if met.isEmpty():
        return edges.limit(0).select(F.col("src").alias("name"), F.col("src").alias("id"), F.lit(True).alias("entry"))
    ids = met.select("s", "n", F.explode(F.array("s", "t")).alias("id")).unionByName(met.join(arms, ["s", "t"]).select("s", "n", "id"))
    return independent(ids.select(F.col("s").alias("name"), "id", "n", (F.col("s") == F.col("id")).alias("entry")), F.col("n")).select("name", "id", "entry")


@tidy
def single_entry_regions(edges: DataFrame) -> DataFrame:
    """``name, id, entry, n, size``: for each node the smallest region that it alone enters and one node alone leaves, of three edges at least.

    A region grows from every node at once: a node joins when all its predecessors are in. When one node alone has joined, and all others lead to members
    but the entry only, the region is complete; its last node may lead back to the entry. Growth ends beyond ``REGION`` edges.
    """
    every = settled(counted(edges))
    # Each node once, with its edges of both kinds.
    out = every.groupBy(F.col("src").alias("id")).agg(F.first("n_out").alias("n_out"), F.first("src_n").alias("size"), F.max(F.col("src_n") * F.when(F.col("src") != F.col("snk"), F.col("snk_n")) == F.col("n_in")).alias("alone"))
    into = every.groupBy(F.col("snk").alias("id")).agg(F.first("n_in").alias("n_in"))
    deg = settled(into.join(out, "id"))
    # A pack has one way in for each of its nodes.
    led = deg.where(F.col("n_in") / F.col("size") <= REGION).select(F.col("id").alias("snk"), F.col("n_out").alias("snk_out"), "size")
    step = settled(every.select("src", "snk", "n_in", (F.col("src_n") * F.col("snk_n")).alias("n")).join(led, "snk"))
    ends = edges.select(F.col("src").alias("last"), F.col("snk").alias("name"), F.lit(1).alias("back"))
    # Of each region: edges inside and edges out of its nodes; of each node outside: how many of its edges come from inside. A node without a successor that
    # it alone leads to can't grow, and no node of a pack has one.
    long = lambda n: F.lit(n).cast("long")
    state = deg.where((F.col("n_out") <= REGION) & F.col("alone") & (F.col("size") == 1))
    state = settled(state.select(F.col("id").alias("name"), long(0).alias("inside"), F.col("n_out").alias("leaving"), F.col("n_in").alias("entering"), F.lit(False).alias("done"), F.lit(True).alias("going")))
    more = not state.isEmpty()
    new, waiting = state.select("name", F.col("name").alias("id"), long(1).alias("n")), None
    joined, done = [new], []
    while more:
        reach = new.drop("n").join(step, F.col("id") == F.col("src")).select("name", "snk", "n_in", "snk_out", "size", "n")
        reach = reach if waiting is None else reach.unionByName(waiting)
        reach = settled(reach.where("name <> snk").groupBy("name", "snk", "n_in", "snk_out", "size").agg(F.sum("n").alias("n")))
        grown = reach.where("n = n_in").groupBy("name").agg(F.sum("size").alias("joined"), F.sum("n_in").alias("more"), F.sum("snk_out").alias("out"), F.min("snk").alias("last"))
        state = state.where("going").join(grown, "name").join(ends, ["name", "last"], "left")
        whole = (F.col("joined") == 1) & (F.col("leaving") == F.col("inside") + F.col("more")) & (F.col("inside") + F.col("more") >= 3) & (F.col("entering") > F.coalesce("back", F.lit(0)))
        leaving = F.col("leaving") + F.col("out")
        state = settled(state.select("name", (F.col("inside") + F.col("more")).alias("inside"), leaving.alias("leaving"), "entering", whole.alias("done"), (~whole & (leaving <= REGION)).alias("going")))
        live = state.where("done OR going").select("name")
        new = reach.where("n = n_in").join(live, "name", "left_semi").select("name", F.col("snk").alias("id"), F.col("size").alias("n"))
        joined.append(new)
        seen = state.agg(F.max("done"), F.max("going")).first()
        if seen[0]:
            done.append(state.where("done").select("name", F.col("inside").alias("size")))
        going = state.where("going").select("name")
        new, waiting, more = new.join(going, "name", "left_semi"), reach.where("n < n_in").join(going, "name", "left_semi"), bool(seen[1])
    if not done:
        return edges.limit(0).select(F.col("src").alias("name"), F.col("src").alias("id"), F.lit(True).alias("entry"), long(1).alias("n"), long(0).alias("size"))
    whole, members = done[0], joined[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    for part in joined[1:]:
        members = members.unionByName(part)
    return settled(members.join(whole, "name").select("name", "id", (F.col("name") == F.col("id")).alias("entry"), "n", "size"))


@tidy
def regions(edges: DataFrame) -> DataFrame:
    """``name, id, entry, n``: disjoint regions, those of fewest edges first; ``n`` nodes stand behind ``id``."""
    found = single_entry_regions(edges)
    return found.drop("size") if found.isEmpty() else independent(found, F.col("size")).select("name", "id", "entry", "n")


def boundary(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """``name, entrances, exits, anchor`` of sets of nodes ``sets(name, id)``: edges in and out, and the greatest sum of frequencies into a member. Sets may overlap."""
    of = sets.select("name", "id")
    into = of.join(edges, F.col("id") == F.col("snk")).select("name", "id", "src", "freq")
    into = into.join(of.select("name", F.col("id").alias("src"), F.lit(True).alias("inner")), ["name", "src"], "left")
    into = into.groupBy("name", "id").agg(F.count_if(F.col("inner").isNull()).alias("n"), F.sum("freq").alias("freq")).groupBy("name").agg(F.sum("n").alias("entrances"), F.max("freq").alias("anchor"))
    out = of.join(edges, F.col("id") == F.col("src")).select("name", "snk").join(of.select("name", F.col("id").alias("snk"), F.lit(True).alias("inner")), ["name", "snk"], "left")
    out = out.groupBy("name").agg(F.count_if(F.col("inner").isNull()).alias("exits"))
    return into.join(out, "name", "full").select("name", F.coalesce("entrances", F.lit(0)).alias("entrances"), F.coalesce("exits", F.lit(0)).alias("exits"), F.coalesce("anchor", F.lit(0)).alias("anchor"))


@tidy
def rare_loops(edges: DataFrame) -> DataFrame:
    """``name, id, entry``: disjoint likeliest cycles with one entrance and one exit whose nodes are all entered less than ``ANCHOR`` times; no entry, so nothing of the loop is left.

    A node with a loop alone isn't one. Only nodes that are entered so rarely, from and to such nodes, are looked at.
    """
    rare = edges.groupBy(F.col("snk").alias("id")).agg(F.sum("freq").alias("freq")).where(f"freq < {ANCHOR}").select("id")
    near = edges.where("src <> snk").join(rare.select(F.col("id").alias("src")), "src", "left_semi").join(rare.select(F.col("id").alias("snk")), "snk", "left_semi")
    near = settled(near.select("src", "snk"))
    both = settled(near.select(F.col("src").alias("id")).intersect(near.select(F.col("snk").alias("id"))))
    nothing = edges.limit(0).select(F.col("src").alias("name"), F.col("src").alias("id"), F.lit(False).alias("entry"))
    if both.isEmpty():
        return nothing
    cycles, _ = likeliest_cycles(cycle_edges(edges), both)
    sets = cycles.select(F.col("source").alias("name"), F.col("node").alias("id"))
    sets = sets.join(sets.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), "name", "left_semi")
    good = boundary(edges, sets).where(f"entrances = 1 AND exits = 1 AND anchor < {ANCHOR}").select("name")
    good = settled(sets.join(good, "name", "left_semi").withColumn("entry", F.lit(False)))
    return nothing if good.isEmpty() else independent(good)


def _applied(now: Contracted, sets: DataFrame, kind: str) -> tuple[Contracted, bool]:
    return (now, False) if sets.isEmpty() else (put_together(now, sets, kind), True)


@tidy
def _shrunk(now: Contracted) -> tuple[Contracted, bool]:
    now, _ = _applied(now, chain_sets(now.edges), "chain")
    return _applied(now, regions(now.edges), "region")


@tidy
def shrink(now: Contracted) -> Contracted:
    """Chains, and then regions, of which branches that meet are the smallest, are put together until none is left.

    Nodes with the same only neighbours go into a region together or not at all, so a large graph is searched with one node for them; once, as their names are known only once.
    """
    pack = now.twins is None and set(now.edges.columns) == {"src", "snk", "freq"} and now.edges.count() >= PACKED_FROM
    now, more = packed(now) if pack else now, True
    while more:
        now, more = _shrunk(now)
    return unpacked(now) if pack else now


@tidy
def level(now: Contracted) -> Contracted:
    """Frequencies balanced at nodes of one edge in and one out; other columns stay."""
    seen = now.edges.agg(F.min("freq").alias("least"), F.max("freq").alias("most")).first()
    if seen.least == seen.most:  # nothing to balance, whatever the nodes
        return now
    thin = degrees(now.edges).where("n_in = 1 AND n_out = 1")
    if thin.isEmpty():
        return now
    flat = balance(now.edges).select("src", "snk", "freq")
    return replace(now, edges=settled(now.edges.drop("freq").join(flat, ["src", "snk"])))


def cycle_edges(edges: DataFrame) -> DataFrame:
    """Weighted edges that a cycle may use: all, or those marked ``inside`` a strongly connected component."""
    all_ = weights(edges.select("src", "snk", "freq"))
    return all_.join(edges.where("inside").select("src", "snk"), ["src", "snk"], "left_semi") if "inside" in edges.columns else all_


@tidy
def simplify(now: Contracted) -> Contracted:
    """All rules to a fixpoint: balance; chains and regions, rare loops and balance, until nothing changes."""
    now = level(now)
    while True:
        rounds = now.rounds
        now = shrink(now)
        changed = True
        while changed:
            now, changed = _applied(now, rare_loops(now.edges), "loop")
        if now.rounds == rounds:
            return now
        now = level(now)
