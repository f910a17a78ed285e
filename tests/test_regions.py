"""Paths, components, regions, kernels and the undoing of contractions against their plain forms."""

import random
from itertools import product

import plain_graph as plain
import pytest
from pyspark.sql import functions as F

from tracewright.operators import contraction, counts, paths, regions, segment


def frame(spark, g):
    return spark.createDataFrame([(a, b, f) for (a, b), f in g.items()], "src string, snk string, freq long")


def sets(df):
    out = {}
    for r in df.collect():
        ids, entry = out.setdefault(r.name, (set(), set()))
        ids.add(r.id)
        if r.entry:
            entry.add(r.id)
    return {n: (frozenset(i), min(e, default=None)) for n, (i, e) in out.items()}


def as_dict(df):
    return {(r.src, r.snk): r.freq for r in df.collect()}


def test_likeliest_paths(spark):
    rng = random.Random(4)
    g = {(f"n{a}", f"n{b}"): rng.randrange(1, 9) for a in range(9) for b in range(9) if rng.random() < 0.3}
    nodes = sorted({n for e in g for n in e})
    pairs = spark.createDataFrame(list(product(nodes, nodes)), "source string, sink string")
    got = {(r.source, r.sink): (r.path, r.prob) for r in paths.likeliest_paths(counts.weights(frame(spark, g)), pairs).collect()}
    w = plain.weighted(g)
    best = {}
    todo = [((a, b), w[a, b]) for a, b in g]
    while todo:
        path, p = todo.pop()
        key = path[0], path[-1]
        if p > best.get(key, 0):
            best[key] = p
        if path[-1] != path[0]:
            todo += [((*path, b), p * w[a, b]) for a, b in g if a == path[-1] and (b not in path or b == path[0])]
    assert got.keys() == best.keys()
    for (source, sink), (path, p) in got.items():
        whole = [*path, source] if source == sink else path
        assert whole[0] == source and whole[-1] == sink
        q = 1.0
        for step in zip(whole, whole[1:], strict=False):
            q *= w[step]
        assert p == q == pytest.approx(best[source, sink])


def test_likeliest_cycles(spark):
    g = plain.random_union(3)
    nodes, found = paths.likeliest_cycles(counts.weights(frame(spark, g)))
    got = {}
    for r in nodes.collect():
        got.setdefault(r.source, {})[r.at] = r.node
    prob = {r.source: r.prob for r in found.collect()}
    want = plain.cycles(g, {a for a, _ in g})
    assert {s: (prob[s], [p[i] for i in range(len(p))]) for s, p in got.items()} == want


def test_components(spark):
    rng = random.Random(1)
    edges = {(f"{k:02}.{rng.randrange(n)}", f"{k:02}.{rng.randrange(n)}") for k in range(30) for n in [rng.randrange(2, 14)] for _ in range(int(n * rng.choice((0.9, 1.2, 2))))}
    # A long path with a loop over its middle, rings, a lone loop.
    edges |= {(f"p{i:04}", f"p{i + 1:04}") for i in range(400)} | {("p0300", "p0100"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("x", "x")}
    succ, pred = plain.around(edges)

    def walk(start, step):
        seen, todo = {start}, [start]
        while todo:
            new = step[todo.pop()] - seen
            seen |= new
            todo += new
        return seen

    nodes = {n for e in edges for n in e}
    got = {r.id: r.scc for r in paths.strongly_connected(spark.createDataFrame(sorted(edges), "src string, snk string")).collect()}
    assert got == {n: min(walk(n, succ) & walk(n, pred)) for n in nodes}


def test_each_rule(spark):
    g = plain.random_union(5, parts=60)
    df = frame(spark, g).cache()
    assert sets(regions.chain_sets(df)) == {n: (frozenset(i), e) for n, i, e in plain.chain_sets(g)}
    assert sets(regions.regions(df)) == {n: (frozenset(i), e) for n, i, e in plain.regions(g)}
    assert sets(regions.rare_loops(df)) == {n: (frozenset(i), None) for n, i, _ in plain.rare_loops(g)}
    # A ring without an entrance, and graphs without any set.
    ring = {("a", "b"): 1, ("b", "c"): 1, ("c", "a"): 1}
    assert sets(regions.chain_sets(frame(spark, ring))) == {"a": (frozenset("abc"), "a")}
    for rule in (regions.chain_sets, regions.diamonds, regions.regions, regions.rare_loops):
        assert rule(frame(spark, {("a", "b"): 1})).count() == 0


def test_diamonds(spark):
    g = {("e", "a"): 9, ("a", "b"): 3, ("a", "c"): 6, ("b", "d"): 3, ("c", "d"): 6, ("d", "f"): 9}
    skip = {("E", "A"): 4, ("A", "B"): 3, ("A", "C"): 1, ("B", "C"): 3, ("C", "F"): 4}
    back = {("1", "2"): 1, ("2", "3"): 5, ("2", "4"): 5, ("3", "5"): 5, ("4", "5"): 5, ("5", "2"): 9, ("5", "6"): 1}
    got = sets(regions.diamonds(frame(spark, g | skip | back)))
    assert got == {"a": (frozenset("abcd"), "a"), "A": (frozenset("ABC"), "A")}
    # What leads back to the branch is a region all the same, and stays as its loop.
    assert sets(regions.regions(frame(spark, back))) == {"2": (frozenset("2345"), "2")}


def test_simplify_and_undo(spark):
    g = plain.random_union(7, parts=8)
    now, want = regions.simplify(contraction.begin(frame(spark, g))), plain.Graph(g).simplify()
    assert as_dict(now.edges) == want.g
    assert as_dict(contraction.expanded(now)) == g
    # Opening nothing gives the shape of the graph as it is; balancing has changed frequencies alone.
    assert as_dict(contraction.opened(now, spark.createDataFrame([], "id string"))).keys() == want.g.keys()
    # One parent opened, with all that it lies in.
    chosen = sorted(want.under)[::3]
    got = as_dict(contraction.opened(now, spark.createDataFrame([(c,) for c in chosen], "id string")))
    inside = {c: p for p, cs in want.under.items() for c in cs}
    wide = set()
    for c in chosen:
        while c:
            wide.add(c)
            c = inside.get(c)
    top = {}
    for n in {n for e in g for n in e}:
        path = [n]
        while path[-1] in inside:
            path.append(inside[path[-1]])
        top[n] = max((i for i, p in enumerate(path) if p not in wide and not any(q not in wide for q in path[i + 1 :])), default=0)
        top[n] = path[top[n]]
    assert {n for e in got for n in e} <= set(top.values())
    apart = {}
    for (a, b), f in g.items():
        if top[a] != top[b]:
            apart[top[a], top[b]] = apart.get((top[a], top[b]), 0) + f
    assert {e: f for e, f in got.items() if e[0] != e[1]} == apart
    # Each edge between two nodes stands for the original edges between their blocks.
    under = {}
    for r in contraction.underlying(now, now.edges).collect():
        under.setdefault((r.src, r.snk), set()).add((r.block_src, r.block_snk))
    for a, b in want.g:
        if a != b:
            assert under[a, b] == {(x, y) for x, y in g if x in want.blocks(a) and y in want.blocks(b)}
    assert {(r.parent, r.id) for r in contraction.leaves(now).collect()} == {(p, b) for p in want.under for b in want.blocks(p)}


def test_fork_with_a_way_back_is_a_loop(spark):
    fork = {("6", "0"): 1, ("0", "1"): 9, ("0", "2"): 1, ("1", "3"): 9, ("2", "4"): 1, ("3", "5"): 9, ("4", "5"): 1, ("5", "0"): 10}
    chain = {("c3", "c0"): 1, ("c0", "c1"): 1, ("c1", "c2"): 1, ("c2", "c0"): 1}
    now = regions.simplify(contraction.begin(frame(spark, fork | chain)))
    # Two nodes and two edges each: the entry, and the loop.
    assert len(as_dict(now.edges)) == 4 and sum(a == b for a, b in as_dict(now.edges)) == 2


@pytest.mark.parametrize("least", [True, False])
def test_kernels(spark, least):
    g = plain.random_union(11, parts=2 if least else 4)
    g |= {("h0", "h1"): 1, ("h1", "h2"): 50, ("h2", "h3"): 1000, ("h3", "h2"): 950, ("h3", "h4"): 50, ("h4", "h9"): 1, ("h4", "h1"): 49, ("h9", "h10"): 1}
    now, want = segment.kernels(frame(spark, g), least), plain.Graph(g).kernels(least).kernel_rows()
    rows = segment.table(now).collect()
    blocks = {r.kernel: r.blocks for r in rows}
    assert sorted((r.blocks, round(r.probability, 9), blocks[r.parents[0]] if r.parents else []) for r in rows) == want
    assert sorted(blocks) == list(range(len(rows))) and all(set(r.children) == {s.kernel for s in rows if r.kernel in s.parents} for r in rows)
    inner = next(r for r in rows if r.blocks == ["h2", "h3"])
    assert (inner.entrances, inner.exits) == (["h1->h2"], ["h3->h4"])
    # Opened until the kernels show: they, and blocks of no kernel.
    shown = {n for e in as_dict(contraction.expanded_to(now)) for n in e}
    top = {r.parent for r in now.log.where("kind = 'kernel'").select("parent").collect()}
    assert shown & top and all(n in top or "@" not in n for n in shown)
    assert now.edges.where(F.col("freq") <= 0).isEmpty()
