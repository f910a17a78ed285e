"""Reachability, cycles, likeliest paths and recursion, as checkpointed fixpoints over edges ``src, snk``."""

from __future__ import annotations

import heapq
from math import inf, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import settled

#: Edges up to which a graph may be brought to the driver.
LOCAL_EDGES = 50_000


def reachable(edges: DataFrame, start: DataFrame, backward: bool = False, inside: DataFrame | None = None, hops: int | None = None) -> DataFrame:
    """``id`` of nodes reached from ``start(id)``, start included; ``inside(id)`` bounds the walk."""
    step = edges.select(F.col("snk").alias("src"), F.col("src").alias("snk")) if backward else edges.select("src", "snk")
    step = step.distinct()
    if inside is not None:
        step = step.join(inside.select(F.col("id").alias("snk")), "snk", "left_semi")
    step = settled(step)
    seen = frontier = settled(start.select("id").distinct())
    while hops is None or hops > 0:
        found = step.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("snk").alias("id")).distinct()
        frontier = settled(found.join(seen, "id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = settled(seen.unionByName(frontier))
        hops = None if hops is None else hops - 1
    return seen


def closure(edges: DataFrame) -> DataFrame:
    """``src, snk`` of all pairs joined by a path of one or more edges, by repeated squaring: rounds are logarithmic in the longest path."""
    pairs = settled(edges.select("src", "snk").distinct())
    size = pairs.count()
    while True:
        longer = pairs.alias("a").join(pairs.alias("b"), F.col("a.snk") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.snk").alias("snk"))
        pairs = settled(pairs.unionByName(longer).distinct())
        if (now := pairs.count()) == size:
            return pairs
        size = now


def cycle_core(edges: DataFrame) -> DataFrame:
    """Edges left after nodes without predecessors, then without successors, are peeled away again and again: empty if there is no cycle."""
    left = settled(edges.select("src", "snk").distinct())
    size = left.count()
    while size:
        kept = left.join(left.select(F.col("snk").alias("src")).distinct(), "src", "left_semi")
        kept = kept.join(left.select(F.col("src").alias("snk")).distinct(), "snk", "left_semi")
        left = settled(kept.select("src", "snk"))
        if (now := left.count()) == size:
            break
        size = now
    return left


def has_cycle(edges: DataFrame) -> bool:
    return not cycle_core(edges).isEmpty()


def simple_cycles(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """``path``: each simple cycle (of at most ``longest`` nodes) once, from its least node."""
    step = settled(edges.select("src", "snk").distinct())
    paths = step.select(F.array("src").alias("path"), F.col("snk").alias("at"))
    found, k = None, 1
    while True:
        closed = paths.where(F.col("at") == F.col("path")[0]).select("path")
        found = closed if found is None else found.unionByName(closed)
        if k == longest:
            break
        grown = paths.where((F.col("at") > F.col("path")[0]) & ~F.array_contains("path", F.col("at")))
        grown = grown.select(F.concat("path", F.array("at")).alias("path"), F.col("at").alias("src")).join(step, "src").select("path", F.col("snk").alias("at"))
        paths, k = settled(grown), k + 1
        if paths.isEmpty():
            break
    return found


def best_paths(edges: DataFrame, sources: DataFrame, hops: int | None = None, cycles: bool = False) -> DataFrame:
    """``source, id, prob, prev``: the likeliest path of one or more edges from each source to each node, by its last step.

    Max-product relaxation: each round joins improved pairs to edges and keeps the best; of equally likely paths the one of
    fewest edges, then of least predecessor. Weights are at most 1, so a path through its own source is never
    better and none is followed there. With ``cycles`` only each source's own cycle counts: what isn't likelier than the best cycle
    found so far isn't followed, which keeps the walks around hot loops short.
    """
    step = settled(edges.select("src", "snk", "weight"))
    cost = lambda p, prev: F.min(F.struct((-p).alias("cost"), F.col(prev).alias("prev")))
    start = sources.select(F.col("id").alias("source")).distinct().join(step, F.col("source") == F.col("src"))
    best = start.groupBy("source", F.col("snk").alias("id")).agg(cost(F.col("weight"), "src").alias("b")).select("source", "id", (-F.col("b.cost")).alias("prob"), "b.prev")
    best = settled(best.withColumn("fresh", F.lit(True)))
    while hops is None or hops > 1:
        fresh = best.where("fresh AND id <> source")
        if cycles:
            known = best.where("id = source").select("source", F.col("prob").alias("known"))
            fresh = fresh.join(known, "source", "left").where("known IS NULL OR prob > known").drop("known")
        tried = fresh.select("source", "id", "prob").join(step, F.col("id") == F.col("src")).select("source", F.col("snk").alias("id"), (F.col("prob") * F.col("weight")).alias("p"), "src")
        tried = tried.groupBy("source", "id").agg(cost(F.col("p"), "src").alias("b"))
        both = best.drop("fresh").join(tried, ["source", "id"], "full")
        better = F.col("b").isNotNull() & (F.col("prob").isNull() | (-F.col("b.cost") > F.col("prob")))
        best = settled(both.select("source", "id", F.when(better, -F.col("b.cost")).otherwise(F.col("prob")).alias("prob"), F.when(better, F.col("b.prev")).otherwise(F.col("prev")).alias("prev"), better.alias("fresh")))
        if best.where("fresh").isEmpty():
            break
        hops = None if hops is None else hops - 1
    return best.drop("fresh")


def likeliest(edges: DataFrame, sources: DataFrame, hops: int | None = None) -> DataFrame:
    """``source, id, prob``: the greatest product of weights over paths of one or more edges from each source; with a source as its own target, of its cycles."""
    return best_paths(edges, sources, hops).select("source", "id", "prob")


def walk_back(best: DataFrame, wanted: DataFrame) -> DataFrame:
    """``source, sink, node, back``: nodes of the paths to ``wanted(source, sink)``, each with its distance from the sink; without the source, unless it is the sink.

    Pointer jumping over the predecessors in ``best``: tables of 1, 2, 4, ... steps, then from the longest down each adds what it reaches
    from the nodes that are there, so a path of n nodes takes 2 log n joins.
    """
    jump = best.where("prev <> source").join(wanted.select("source").distinct(), "source", "left_semi").select("source", "id", F.col("prev").alias("up"), F.lit(1).alias("far"))
    jumps = []
    while True:
        jump = settled(jump)
        if jump.isEmpty():
            break
        jumps.append(jump)
        on = jump.select("source", F.col("id").alias("up"), F.col("up").alias("top"), F.col("far").alias("more"))
        jump = jump.join(on, ["source", "up"]).select("source", "id", F.col("top").alias("up"), (F.col("far") + F.col("more")).alias("far"))
    nodes = wanted.select("source", "sink", F.col("sink").alias("node"), F.lit(0).alias("back"))
    for jump in reversed(jumps):
        reached = nodes.join(jump.withColumnRenamed("id", "node"), ["source", "node"]).select("source", "sink", F.col("up").alias("node"), (F.col("back") + F.col("far")).alias("back"))
        nodes = nodes.unionByName(reached)
    return nodes


def local_path(edges: dict, source, sink) -> list:
    """Nodes of the likeliest path from source to sink (a cycle if they are one), by Dijkstra over -ln weight; empty if none.

    ``edges``: node -> {successor: weight}.
    """
    heap, cost, back = [], {}, {}
    for n, w in edges.get(source, {}).items():
        if w > 0 and -log(w) < cost.get(n, inf):
            cost[n], back[n] = -log(w), source
            heapq.heappush(heap, (cost[n], str(n), n))
    done = set()
    while heap:
        d, _, n = heapq.heappop(heap)
        if n in done:
            continue
        done.add(n)
        if n == sink:
            path = [n]
            while back[path[-1]] != source:
                path.append(back[path[-1]])
            return [source, *reversed(path)] if source != sink else list(reversed(path))
        for m, w in edges.get(n, {}).items():
            if w > 0 and d - log(w) < cost.get(m, inf):
                cost[m], back[m] = d - log(w), n
                heapq.heappush(heap, (cost[m], str(m), m))
    return []


def likeliest_paths(edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``source, sink, path, prob`` of each pair in ``pairs(source, sink)`` (all, if left out) that a path joins: its nodes in order, source first, sink last; a cycle has its node once, at the front."""
    best = best_paths(edges, (edges.withColumnRenamed("src", "source") if pairs is None else pairs).select(F.col("source").alias("id")))
    wanted = best.select("source", F.col("id").alias("sink"), "prob")
    wanted = wanted if pairs is None else settled(pairs.distinct().join(wanted, ["source", "sink"]))
    nodes = walk_back(best, wanted.select("source", "sink"))
    order = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "node"))), lambda x: x["node"])
    paths = nodes.groupBy("source", "sink").agg(order.alias("rest"))
    # Of a cycle the sink comes last and is the source.
    path = F.when(F.col("source") == F.col("sink"), F.concat(F.array("source"), F.slice("rest", 1, F.size("rest") - 1))).otherwise(F.concat(F.array("source"), F.col("rest")))
    return paths.join(wanted, ["source", "sink"]).select("source", "sink", path.alias("path"), "prob")


def likeliest_cycles(edges: DataFrame, sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``source, node, at`` (0 for the source, then along the cycle) and ``source, prob``: the likeliest cycle through each node (of ``sources(id)``) that has one."""
    best = best_paths(edges, edges.select(F.col("src").alias("id")) if sources is None else sources, cycles=True)
    found = best.where("id = source").select("source", F.col("id").alias("sink"), "prob")
    nodes = settled(walk_back(best, found))
    length = nodes.groupBy("source").agg(F.count("*").alias("n"))
    nodes = nodes.join(length, "source").select("source", "node", ((F.col("n") - F.col("back")) % F.col("n")).alias("at"))
    return nodes, found.select("source", "prob")


def _compressed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges(src, snk)`` without what lies on no cycle for want of a predecessor or successor, and with nodes of one edge in and one out spliced out.

    Also ``id, src, snk``: the edge that each spliced node stands on. Peeling and splicing take turns, so
    that trees and long paths are gone after a number of rounds about logarithmic in their length.
    """
    live = settled(edges.where("src <> snk").select("src", "snk").distinct())
    spliced, size = None, live.count()
    while size:
        ends = F.inline(F.array(F.struct(F.col("src").alias("id"), F.lit(None).alias("prev"), F.col("snk").alias("next")), F.struct(F.col("snk").alias("id"), F.col("src").alias("prev"), F.lit(None).alias("next"))))
        near = settled(live.select(ends).groupBy("id").agg(F.count("prev").alias("n_in"), F.count("next").alias("n_out"), F.min("prev").alias("prev"), F.min("next").alias("next")))
        thin = near.where("n_in = 1 AND n_out = 1 AND prev <> next").select("id", "prev", "next")
        # Independent thin nodes go: those whose hash is the least among their thin neighbours.
        key = lambda c: F.struct(F.xxhash64(c, F.lit(size)), F.col(c))
        gone = thin.join(thin.select(F.col("id").alias("prev"), F.lit(1).alias("a")), "prev", "left").join(thin.select(F.col("id").alias("next"), F.lit(1).alias("b")), "next", "left")
        gone = gone.where((F.col("a").isNull() | (key("id") < key("prev"))) & (F.col("b").isNull() | (key("id") < key("next"))))
        gone = settled(gone.select("id", F.col("prev").alias("src"), F.col("next").alias("snk")))
        spliced = gone if spliced is None else spliced.unionByName(gone)
        away = near.where("n_in = 0 OR n_out = 0").select("id").unionByName(gone.select("id"))
        kept = live.join(away.select(F.col("id").alias("src")), "src", "left_anti").join(away.select(F.col("id").alias("snk")), "snk", "left_anti").select("src", "snk")
        live = settled(kept.unionByName(gone.select("src", "snk")).distinct())
        if (now := live.count()) == size:
            break
        size = now
    return live, live.select(F.col("src").alias("id"), "src", "snk").limit(0) if spliced is None else spliced


def strongly_connected(edges: DataFrame) -> DataFrame:
    """``id, scc``: strongly connected components, named by their least node.

    What lies on no cycle is peeled off and paths are spliced first. Then every node takes the least node that reaches it as its colour; the nodes of a
    colour from which that node can be reached are its component. These go, as do edges between colours, until none is left.
    Rounds follow the diameter of what is left; rows never exceed edges.
    """
    nodes = edges.select(F.explode(F.array("src", "snk")).alias("id")).distinct()
    live, spliced = _compressed(edges)
    found = None
    while not live.isEmpty():
        colour = settled(live.select(F.explode(F.array("src", "snk")).alias("id")).distinct().withColumn("c", F.col("id")))
        while True:
            low = live.join(colour, F.col("src") == F.col("id")).groupBy("snk").agg(F.min("c").alias("low"))
            nxt = settled(colour.join(low, F.col("id") == F.col("snk"), "left").select("id", F.least("c", "low").alias("c"), F.coalesce(F.col("low") < F.col("c"), F.lit(False)).alias("fresh")))
            colour = nxt.drop("fresh")
            if nxt.where("fresh").isEmpty():
                break
        one = live.join(colour.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("id").alias("snk"), F.col("c").alias("b")), "snk").where("a = b")
        one = settled(one.select("src", "snk", F.col("a").alias("c")))
        # Backwards from each colour's own node; both ends of an edge have one colour.
        mark = colour.select("id", F.col("c").alias("scc"), (F.col("id") == F.col("c")).alias("hit"))
        while True:
            back = one.join(mark.where("hit").select(F.col("id").alias("snk")), "snk", "left_semi").select(F.col("src").alias("id"), F.lit(True).alias("reached")).distinct()
            nxt = settled(mark.join(back, "id", "left").select("id", "scc", (F.col("hit") | F.coalesce("reached", F.lit(False))).alias("hit"), (~F.col("hit") & F.coalesce("reached", F.lit(False))).alias("fresh")))
            mark = nxt.drop("fresh")
            if nxt.where("fresh").isEmpty():
                break
        part = mark.where("hit").select("id", "scc")
        found = part if found is None else found.unionByName(part)
        live = one.join(part.select(F.col("id").alias("src")), "src", "left_anti").join(part.select(F.col("id").alias("snk")), "snk", "left_anti").select("src", "snk")
        live = settled(live.join(live.select(F.col("snk").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("snk")).distinct(), "snk", "left_semi").select("src", "snk"))
    if found is None:
        return nodes.select("id", F.col("id").alias("scc"))
    # A spliced node is in a component if both ends of its edge are; ends may be spliced later themselves.
    found = settled(found)
    left = spliced
    while not left.isEmpty():
        more = left.join(found.select(F.col("id").alias("src"), F.col("scc").alias("a")), "src").join(found.select(F.col("id").alias("snk"), F.col("scc").alias("b")), "snk").where("a = b")
        more = settled(more.select("id", F.col("a").alias("scc")))
        if more.isEmpty():
            break
        found = settled(found.unionByName(more))
        left = settled(left.join(more, "id", "left_anti"))
    # Spliced nodes may be less than the colour.
    named = found.groupBy("scc").agg(F.min("id").alias("least"))
    found = found.join(named, "scc").select("id", F.col("least").alias("scc"))
    return nodes.join(found, "id", "left").select("id", F.coalesce("scc", "id").alias("scc"))


def fully_connected(edges: DataFrame, members: DataFrame) -> bool:
    """Whether every member reaches every other inside the member set."""
    inner = edges.join(members.select(F.col("id").alias("src")), "src", "left_semi").join(members.select(F.col("id").alias("snk")), "snk", "left_semi")
    start = members.orderBy("id").limit(1)
    n = members.distinct().count()
    return reachable(inner, start).count() == n == reachable(inner, start, backward=True).count()


def recursion(calls: DataFrame) -> DataFrame:
    """``fn, direct, indirect`` over ``calls(caller, callee)``: calls itself; calls itself through others."""
    edges = calls.select(F.col("caller").alias("src"), F.col("callee").alias("snk")).distinct()
    others = edges.where("src <> snk")
    direct = edges.where("src = snk").select(F.col("src").alias("fn"), F.lit(True).alias("direct"))
    group = settled(strongly_connected(others))
    many = group.groupBy("scc").agg(F.count("*").alias("n")).where("n > 1").select("scc")
    indirect = group.join(many, "scc", "left_semi").select(F.col("id").alias("fn"), F.lit(True).alias("indirect"))
    fns = edges.select(F.explode(F.array("src", "snk")).alias("fn")).distinct()
    flags = fns.join(direct, "fn", "left").join(indirect, "fn", "left")
    return flags.select("fn", F.coalesce("direct", F.lit(False)).alias("direct"), F.coalesce("indirect", F.lit(False)).alias("indirect"))


def recursion_counts(flags: DataFrame, live: DataFrame) -> DataFrame:
    """``direct, indirect, live``: how many functions are what."""
    n = live.select(F.count_distinct("fn").alias("live"), F.lit(0).alias("k"))
    return flags.agg(F.count_if("direct").alias("direct"), F.count_if("indirect").alias("indirect")).withColumn("k", F.lit(0)).join(n, "k").drop("k")


def recursion_entrances(calls: DataFrame) -> DataFrame:
    """``scc, caller, callee``: calls into a recursion cycle from outside it."""
    edges = calls.select(F.col("caller").alias("src"), F.col("callee").alias("snk")).distinct()
    group = settled(strongly_connected(edges))
    many = group.groupBy("scc").agg(F.count("*").alias("n")).where("n > 1").select("scc")
    inside = group.join(many, "scc")
    return edges.join(inside.select(F.col("id").alias("snk"), "scc"), "snk").join(group.select(F.col("id").alias("src"), F.col("scc").alias("from")), "src").where(F.col("from") != F.col("scc")).select("scc", F.col("src").alias("caller"), F.col("snk").alias("callee"))


def condensed(edges: DataFrame, group: DataFrame) -> DataFrame:
    """``a, b``: edges between the components in ``group(id, scc)``; without cycles."""
    ends = edges.join(group.select(F.col("id").alias("src"), F.col("scc").alias("a")), "src").join(group.select(F.col("id").alias("snk"), F.col("scc").alias("b")), "snk")
    return ends.where("a <> b").select("a", "b").distinct()


def embedded(calls: DataFrame) -> DataFrame:
    """``fn, below``: functions reached by calls, other than the function itself and its recursion partners.

    A row for each pair is the result; pairs of components are walked once each, new ones only, and become pairs of functions at the end.
    """
    edges = calls.select(F.col("caller").alias("src"), F.col("callee").alias("snk")).distinct()
    group = settled(strongly_connected(edges))
    step = settled(condensed(edges, group))
    below = fresh = step
    while not fresh.isEmpty():
        longer = fresh.select("a", F.col("b").alias("on")).join(step.withColumnRenamed("a", "on"), "on").select("a", "b").distinct()
        fresh = settled(longer.join(below, ["a", "b"], "left_anti"))
        below = settled(below.unionByName(fresh))
    return below.join(group.select(F.col("id").alias("fn"), F.col("scc").alias("a")), "a").join(group.select(F.col("id").alias("below"), F.col("scc").alias("b")), "b").select("fn", "below")


def schedule(calls: DataFrame) -> DataFrame:
    """``fn, level``: bottom-up order; a function comes after all it calls, recursion partners at one level (longest path over the condensed graph)."""
    edges = calls.select(F.col("caller").alias("src"), F.col("callee").alias("snk")).distinct()
    group = settled(strongly_connected(edges))
    dag = settled(condensed(edges, group))
    level = group.select(F.col("scc").alias("g"), F.lit(0).alias("level")).distinct()
    # The condensed graph has no cycle, so levels stop rising.
    while True:
        raised = dag.join(level, F.col("b") == F.col("g")).groupBy("a").agg((F.max("level") + 1).alias("up"))
        nxt = settled(level.join(raised, F.col("g") == F.col("a"), "left").select("g", F.coalesce("up", "level").alias("next"), "level"))
        done = nxt.where("next <> level").isEmpty()
        level = nxt.select("g", F.col("next").alias("level"))
        if done:
            break
    return group.join(level, F.col("scc") == F.col("g")).select(F.col("id").alias("fn"), "level")


def between(edges: DataFrame, entrance: DataFrame, exits: DataFrame) -> DataFrame:
    """``id``: nodes on walks from the entrance that go no further than the exits, both included."""
    step = edges.join(exits.select(F.col("id").alias("src")), "src", "left_anti")
    return reachable(step, entrance)


def prune(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Edges whose source can be reached from ``start``."""
    return edges.join(reachable(edges, start).select(F.col("id").alias("src")), "src", "left_semi")
