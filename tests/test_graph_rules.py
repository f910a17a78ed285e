"""Rewrites, paths and segmentation on hand-built graphs."""

import random
from math import prod

import pytest
from pyspark.sql import functions as F

from tracewright.operators import counts, graph, local_segment, paths, rewrite

CHAIN = [(3, 0, 1), (0, 1, 1), (1, 2, 1), (2, 0, 1)]
FORK = [(6, 0, 1), (0, 1, 9), (0, 2, 1), (1, 3, 9), (2, 4, 1), (3, 5, 9), (4, 5, 1), (5, 0, 10)]


def frame(spark, edges):
    return counts.weights(spark.createDataFrame(edges, "src long, snk long, freq long"))


def shrunk(edges):
    g = rewrite.LocalGraph(edges).simplify()
    assert set().union(*(g.leaves(n) for n in g.nodes())) == {n for a, b, _ in edges for n in (a, b)}
    return len(g.nodes())


def test_loops_shrink():
    # A self loop is an inner edge of the supernode: the entry and the loop remain.
    assert shrunk(CHAIN) == 2
    # A branch that meets again goes, but not one whose meeting point leads back to it.
    assert shrunk([*FORK[:-1], (5, 7, 10)]) == 3
    assert shrunk(FORK) == 5


def test_skip_diamond():
    g = rewrite.LocalGraph([(9, 0, 4), (0, 1, 3), (0, 2, 1), (1, 2, 3), (2, 8, 4)])
    assert g.select(0) == {0, 1, 2}


def test_bottleneck_and_fan():
    g = rewrite.LocalGraph([(9, 0, 8), (0, 1, 4), (0, 2, 4), (1, 3, 2), (1, 4, 2), (2, 3, 2), (2, 4, 2), (3, 5, 4), (4, 5, 4), (5, 8, 8)])
    assert g.bottleneck(0) == {0, 1, 2, 3, 4, 5}
    assert g.fan({0, 1, 2, 3, 4, 5}, 0, 5) and not g.fan({0, 1, 2, 3, 4}, 0, 4)


def test_level_takes_the_lesser():
    g = rewrite.LocalGraph([(0, 1, 5), (1, 2, 3)])
    assert g.level() and g.succ[0][1] == 3 and not g.level()


def test_random_graphs_keep_invariants():
    for seed in range(20):
        rng = random.Random(seed)
        edges = [(i, i + 1, 5) for i in range(15)] + [(a, b, rng.randint(1, 9)) for _ in range(10) if (a := rng.randrange(16)) != (b := rng.randrange(16))]
        g = rewrite.LocalGraph(edges)
        before = set(g.nodes())
        entry = 0
        g.simplify()
        top = next(n for n in g.nodes() if entry in g.leaves(n)) if g.nodes() else None
        assert set().union(*(g.leaves(n) for n in g.nodes()), set()) <= before
        if top is not None:
            assert rewrite.problems(g, top) == []


def test_dataframe_chain_and_contract_agree_with_local(spark):
    e = frame(spark, CHAIN)
    got = {r.id: r.super for r in rewrite.chains(e).collect()}
    assert got == {0: 0, 1: 0, 2: 0}
    assert [tuple(r) for r in rewrite.contract(e, rewrite.chains(e)).collect()] == [(3, 0, 1, 1.0)]
    back = rewrite.expand(None, rewrite.chains(e), e)
    assert sorted((r.src, r.snk, r.freq) for r in back.collect()) == sorted(CHAIN)


def test_balance_to_fixpoint(spark):
    e = frame(spark, [(0, 1, 9), (1, 2, 7), (2, 3, 5)])
    assert {r.freq for r in rewrite.balance(e).collect()} == {5}


def test_inline_copies_per_site(spark):
    e = frame(spark, [(1, 10, 3), (2, 10, 1), (10, 11, 4), (11, 3, 4)])
    body = spark.createDataFrame([("f", 10), ("f", 11)], "fn string, id long")
    sites = spark.createDataFrame([("f", 1, 10, 0.75), ("f", 2, 10, 0.25)], "fn string, site long, entry long, share double")
    got = {(r.src, r.snk): r.freq for r in rewrite.inline(e, body, sites).collect()}
    assert got == {("1", "10@1"): 3, ("2", "10@2"): 1, ("10@1", "11@1"): 3, ("10@2", "11@2"): 1, ("11@1", "3"): 3, ("11@2", "3"): 1}


def test_likeliest_agrees_with_dijkstra(spark):
    rng = random.Random(4)
    edges = [(a, b, rng.randint(1, 9)) for a in range(8) for b in range(8) if rng.random() < 0.4]
    local = rewrite.LocalGraph(edges).weighted()
    got = {(r.source, r.id): r.prob for r in paths.likeliest(frame(spark, edges), spark.createDataFrame([(i,) for i in range(8)], "id long")).collect()}
    for a in range(8):
        for b in range(8):
            path = paths.local_path(local, a, b)
            if not path:
                assert (a, b) not in got
                continue
            steps = [a, *path] if a == b else path
            steps = [a, *path[:-1], b] if a == b else path
            p = prod(local[x][y] for x, y in zip(steps, steps[1:], strict=False))
            assert got[a, b] == pytest.approx(p)


def test_cycles_and_recursion(spark):
    dag = spark.createDataFrame([(0, 1), (1, 2), (0, 2)], "src long, snk long")
    loop = dag.union(spark.createDataFrame([(2, 1)], "src long, snk long"))
    assert not paths.has_cycle(dag) and paths.has_cycle(loop)
    assert [r.path for r in paths.simple_cycles(loop).collect()] == [[1, 2]]
    calls = loop.toDF("caller", "callee").union(spark.createDataFrame([(0, 0)], "a long, b long"))
    flags = {r.fn: (r.direct, r.indirect) for r in paths.recursion(calls).collect()}
    assert flags == {0: (True, False), 1: (False, True), 2: (False, True)}
    assert {(r.caller, r.callee) for r in paths.recursion_entrances(calls).collect()} == {(0, 1), (0, 2)}
    assert {r.fn: r.level for r in paths.schedule(calls).collect()} == {0: 1, 1: 0, 2: 0}
    assert paths.fully_connected(loop, spark.createDataFrame([(1,), (2,)], "id long"))
    walked = paths.between(loop, spark.createDataFrame([(0,)], "id long"), spark.createDataFrame([(2,)], "id long"))
    assert {r.id for r in walked.collect()} == {0, 1, 2}


def test_segmentation_finds_the_hot_loop():
    edges = [(0, 1, 1), (1, 2, 100), (2, 3, 100), (3, 1, 99), (3, 4, 1), (4, 5, 1)]
    found = local_segment.kernels(rewrite.LocalGraph(edges))
    assert len(found) == 1 and found[0].blocks == {1, 2, 3}
    assert len(found[0].entrances) == len(found[0].exits) == 1


def test_nested_kernels():
    inner = [(2, 3, 1000), (3, 2, 950), (3, 4, 50), (4, 9, 1)]
    edges = [(0, 1, 1), (1, 2, 50), *inner, (4, 1, 49), (9, 10, 1)]
    found = local_segment.kernels(rewrite.LocalGraph(edges))
    assert any(k.blocks == {2, 3} for k in found)


def test_typed_and_sentinels(spark):
    e = spark.createDataFrame([("a", "b", 3), ("a", "c", 1), ("b", "c", 3)], "src string, snk string, freq long")
    kinds = {(r.src, r.snk): (r.kind, r.weight) for r in graph.typed(e).collect()}
    assert kinds == {("a", "b"): ("conditional", 0.75), ("a", "c"): ("conditional", 0.25), ("b", "c"): ("unconditional", 1.0)}
    one = spark.createDataFrame([("a",)], "block string")
    closed = graph.add_sentinels(e, one, spark.createDataFrame([("c",)], "block string"))
    assert graph.entry_node(closed).first()[0] == "a" and graph.terminators(closed).first()[0] == "c"
    members = spark.createDataFrame([("v", "a"), ("w", "v")], "parent string, child string")
    assert [tuple(r) for r in graph.block_members(members).collect()] == [("a", "w")]


def test_counting_property(spark):
    pairs = spark.range(300).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + 25)).alias("snk"))
    hub = spark.range(5000).select(F.lit(-1).cast("long").alias("src"), F.col("id").alias("snk"))
    assert counts.edge_counts(pairs.union(hub)).where("freq <> 1").count() == 0


def test_simple_cycles_have_no_bound(spark):
    ring = spark.createDataFrame([(i, i % 10 + 1) for i in range(1, 11)] + [(3, 1)], "src long, snk long")
    assert sorted(r.path for r in paths.simple_cycles(ring).collect()) == [[1, 2, 3], list(range(1, 11))]
    assert [r.path for r in paths.simple_cycles(ring, longest=3).collect()] == [[1, 2, 3]]
