"""Graphs in pieces against the plain forms and the distributed ones; graphs of orders that aren't in pieces."""

import plain_graph as plain
import pytest
from pyspark.sql import functions as F

from tracewright.operators import pieces, regions
from tracewright.plans import queries


def fans(k):
    """Branches over several arms one after the other up to a node of all pieces, some with one arm; frequencies rare and frequent."""
    g, at = {}, f"c{k}"
    for i in range(4 + k % 5):
        o, z, n = f"o{k}.{i:02}", f"z{k}.{i:02}", (3, 1, 2, 5)[(i + k) % 4]
        g[at, o] = n * (1 + k % 3)
        for a in range(n):
            g[o, f"l{k}.{i:02}.{a}"] = g[f"l{k}.{i:02}.{a}", z] = 1 + k % 3
        at = z
    g[at, "last"] = 1
    return g


def graphs():
    mixed = {e: f for seed in range(40) for e, f in plain.random_union(seed, parts=1).items()}
    return [fans(k) for k in range(12)] + [plain.random_union(seed, parts=3) for seed in range(150)] + [mixed]


def test_piece_equals_plain():
    kinds = 0
    for g in graphs():
        now, want = pieces.Piece(g).simplify(), plain.Graph(g).simplify()
        assert now.edges() == want.g
        assert {p: set(ids) for p, ids in now.under.items()} == want.under
        assert now.blocks == {p: len(want.blocks(p)) for p in want.under} and now.least == {p: min(want.blocks(p)) for p in want.under}
        assert now.opened(set(now.under)) == g
        kinds += len({kind for kind, *_ in want.log}) == 3
    assert kinds > 5


def in_pieces(spark, rows):
    return spark.createDataFrame([(p, len(g), [(a, b, f) for (a, b), f in part.items()]) for p, g, part in rows], "piece string, n long, part array<struct<src:string,snk:string,freq:long>>").repartition(3, "piece")


@pytest.mark.parametrize("limit", [2_000, 30])
def test_pieces_equal_the_whole_graph(spark, monkeypatch, limit):
    monkeypatch.setattr(pieces, "PIECE", limit)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # pieces run on from batch to batch
    try:
        gs = {f"p{k}": fans(k) for k in range(9)}
        assert min(map(len, gs.values())) <= 30 < max(map(len, gs.values()))
        split = [(p, g, dict(list(g.items())[i::4])) for p, g in gs.items() for i in range(4)]
        parts, whole = in_pieces(spark, split), {e: f for g in gs.values() for e, f in g.items()}
        edges = spark.createDataFrame([(a, b, f) for (a, b), f in whole.items()], "src string, snk string, freq long")
        # Parents are numbered by the rounds of their piece.
        kept = lambda df: sorted((r.src.split("@")[0], r.snk.split("@")[0], r.freq, r.blocks or 0, r.least or "") for r in df.collect())
        got = kept(pieces.simplify(parts))
        assert any(r[3] for r in got) and got == kept(pieces.simplify_whole(edges))
        row = lambda df: sorted((r.src, r.snk, r.freq, round(r.weight, 9)) for r in df.collect())
        assert row(pieces.undone(parts)) == row(pieces.undone_whole(edges))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def tables(spark, path, lines, orders):
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")
    return str(path)


LINES = [(k, n) for k in (1, 2, 3, 5, 8, 9) for n in range(1 + k % 4)] + [(1, 0), (77, 1), (77, 2)]
ORDERS = [(1, 10), (2, 10), (3, 11), (5, 10), (5, 10), (8, 11), (9, 12), (44, 12)]
ODD = {"plain": ([], []), "two customers": ([], [(3, 10)]), "null keys": ([(None, 1), (2, None)], [(8, None)])}


@pytest.mark.parametrize("odd", ODD)
def test_order_graph_in_pieces(spark, tmp_path, monkeypatch, odd):
    at = tables(spark, tmp_path, LINES + ODD[odd][0], ORDERS + ODD[odd][1])
    edges = queries.order_graph(spark, at).groupBy("src", "snk").agg(F.sum("freq").alias("freq"))
    whole = sorted(map(tuple, edges.collect()))
    if odd != "plain":  # takes the distributed form, which other tests run
        assert not queries.order_parts(spark, at).where("odd").isEmpty()
        monkeypatch.setattr(pieces, "simplify_whole", lambda e: e.withColumns({"blocks": F.lit(0), "least": F.lit("whole")}))
        assert {r.least for r in queries.order_regions(spark, at).collect()} == {"whole"}
        return
    parts = queries.order_parts(spark, at)
    cut = parts.select("piece", F.inline("part")).groupBy("piece", "src", "snk").agg(F.sum("freq").alias("freq"))
    assert sorted(tuple(r)[1:] for r in cut.collect()) == whole
    assert parts.where("odd").isEmpty() and cut.groupBy("src").agg(F.count_distinct("piece").alias("n")).where("n > 1").isEmpty()
    # A graph in pieces isn't rewritten by rounds over all of it.
    monkeypatch.setattr(regions, "simplify", None)
    undone = {r.kind: (r.edges, r.freq) for r in queries.order_regions_undone(spark, at).collect()}
    assert undone == {k: (sum(a[0] == k for a, _, _ in whole), sum(f for a, _, f in whole if a[0] == k)) for k in {a[0] for a, _, _ in whole}}
    # The order that is there twice comes after itself, which leaves a loop of its parent.
    want = plain.Graph({(a, b): f for a, b, f in whole}).simplify()
    rows = sorted((r.customer, r.least, r.blocks, r.freq) for r in queries.order_regions(spark, at).collect())
    assert rows == sorted((a, min(want.blocks(b)), len(want.blocks(b)), f) for (a, b), f in want.g.items() if a.startswith("c.") and b in want.under)
