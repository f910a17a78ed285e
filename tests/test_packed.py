"""Graphs that are shrunk with like nodes packed, and what their stored frames leave on disk."""

import random
from pathlib import Path

import plain_graph as plain
from pyspark.sql import functions as F

from tracewright.operators import contraction, iterate, regions


def frame(spark, g):
    return spark.createDataFrame([(a, b, f) for (a, b), f in g.items()], "src string, snk string, freq long")


def as_dict(df):
    return {(r.src, r.snk): r.freq for r in df.collect()}


def fans():
    """Branches over several arms that meet again, one after the other; others that never become a region, or are too wide for one."""
    r, g = random.Random(2), {}
    for k in range(4):
        at = f"c{k}"
        for i in range(3):
            o, z, n = f"o{k}.{i}", f"z{k}.{i}", r.choice((1, 2, 5))
            g[at, o] = n
            for a in range(n):
                g[o, f"l{k}.{i}.{a}"] = g[f"l{k}.{i}.{a}", z] = 1
            at = z
        g[at, "last"] = 1
    # Arms of other frequencies around a node that is entered from elsewhere, a fan with a direct way and a way back.
    g |= {("x", "y"): 9, ("y", "a1"): 4, ("y", "a2"): 5, ("a1", "w"): 4, ("a2", "w"): 5, ("v", "w"): 7, ("w", "u"): 16, ("t", "v"): 7}
    g |= {("h", "s"): 2, ("s", "b1"): 1, ("s", "b2"): 1, ("s", "e"): 1, ("b1", "e"): 1, ("b2", "e"): 1, ("e", "s"): 1, ("e", "f"): 2, ("f", "i"): 2}
    wide = {("W0", "W1"): 1, ("W2", "W3"): 1}
    return g | wide | {e: 1 for i in range(230) for e in (("W1", f"m{i:03}"), (f"m{i:03}", "W2"))}


def test_packed_equals_plain(spark, monkeypatch):
    monkeypatch.setattr(regions, "PACKED_FROM", 0)
    g = fans() | plain.random_union(7, parts=6)
    now, want = regions.simplify(contraction.begin(frame(spark, g))), plain.Graph(g).simplify()
    assert now.twins.count() > 240
    assert as_dict(now.edges) == want.g
    assert {(r.parent, r.id) for r in contraction.leaves(now).collect()} == {(p, b) for p in want.under for b in want.blocks(p)}
    # Undone from the log, row by row, and at once.
    assert as_dict(contraction.opened(now, now.log.select(F.col("parent").alias("id")).distinct())) == g == as_dict(contraction.expanded(now))
    tops = contraction.tops(now).groupBy("top").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("top LIKE '%@%'")
    assert sorted(map(tuple, contraction.sizes(now).collect())) == sorted(map(tuple, tops.collect()))


def test_stored_frames_go(spark):
    folder = Path(iterate.shared_folder(spark).removeprefix("file://"))
    kept = lambda: {p.name for p in folder.iterdir()}
    before = kept()
    now = regions.simplify(contraction.begin(frame(spark, {e: f for e, f in fans().items() if e[0][0] not in "Wm"})))
    frames = (now.original, now.edges, *now.parts)
    # The graph at first and at last, and the sets of the log: nothing of the rounds between.
    read = {x for f in frames for file in f.inputFiles() for x in file.split("/")}
    assert kept() - before <= read and len(kept() - before) <= len(frames)
