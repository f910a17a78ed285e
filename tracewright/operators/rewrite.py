"""Contraction rules over the weighted graph.

The rules that look at degrees alone (``contract``, ``chains``, ``balance``, ``inline``) are DataFrame
plans for graphs of any size. The rules that search regions around a node run on
``LocalGraph``, for graphs that fit the driver (``paths.LOCAL_EDGES`` edges): transition graphs
have an edge for each pair of program blocks, not for each event.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .counts import weights
from .iterate import checkpoint, components
from .paths import LOCAL_EDGES, local_path

#: Certainty of a chain edge, edges of a bottleneck region, frequency that a loop needs to be a task.
CERTAIN, REGION, ANCHOR = 0.9999, 200, 16


def contract(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``src, snk, freq, weight`` after nodes in ``members(id, super)`` became their supernode: inner edges go, parallel ones add up."""
    to = lambda end: members.select(F.col("id").alias(end), F.col("super").alias(f"_{end}"))
    moved = edges.join(to("src"), "src", "left").join(to("snk"), "snk", "left")
    inner = F.col("_src").isNotNull() & F.coalesce(F.col("_src") == F.col("_snk"), F.lit(False))
    ends = moved.where(~inner).select(F.coalesce("_src", "src").alias("src"), F.coalesce("_snk", "snk").alias("snk"), "freq")
    return weights(ends.groupBy("src", "snk").agg(F.sum("freq").alias("freq")))


def expand(edges: DataFrame, members: DataFrame, original: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """``original`` again, contracted by the supernodes in ``keep(super)`` only: by none, if it is left out."""
    return weights(original.select("src", "snk", "freq")) if keep is None else contract(original, members.join(keep.select("super"), "super", "left_semi"))


def chain_edges(edges: DataFrame) -> DataFrame:
    """``src, snk`` that a chain may be merged over: the source's only successor has no other predecessor, one successor, and no edge back; the source has a predecessor."""
    out = edges.groupBy("src").agg(F.count("*").alias("n_out"))
    into = edges.groupBy("snk").agg(F.count("*").alias("n_in"))
    one = edges.join(out.where("n_out = 1"), "src").join(into.where("n_in = 1"), "snk").select("src", "snk")
    one = one.join(out.where("n_out = 1").select(F.col("src").alias("snk")), "snk", "left_semi").join(into.select(F.col("snk").alias("src")), "src", "left_semi")
    return one.join(edges.select(F.col("snk").alias("src"), F.col("src").alias("snk")), ["src", "snk"], "left_anti")


def chains(edges: DataFrame) -> DataFrame:
    """``id, super``: nodes of each maximal chain, named by its least node."""
    links = chain_edges(edges)
    ids = links.select(F.explode(F.array("src", "snk")).alias("id")).distinct()
    return components(ids, links.select(F.col("src").alias("a"), F.col("snk").alias("b"))).select("id", F.col("root").alias("super"))


def balance(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Nodes with one edge in and one out get the lesser frequency on both, all at once, until nothing changes (or for some rounds)."""
    now = edges.select("src", "snk", "freq")
    while rounds is None or rounds > 0:
        into = now.groupBy(F.col("snk").alias("id")).agg(F.count("*").alias("n_in"), F.first("freq").alias("f_in"))
        out = now.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"), F.first("freq").alias("f_out"))
        low = into.join(out, "id").where("n_in = 1 AND n_out = 1").select("id", F.least("f_in", "f_out").alias("least"))
        nxt = now.join(low.select(F.col("id").alias("src"), F.col("least").alias("a")), "src", "left").join(low.select(F.col("id").alias("snk"), F.col("least").alias("b")), "snk", "left")
        nxt = nxt.select("src", "snk", F.least("freq", F.coalesce("a", "freq"), F.coalesce("b", "freq")).alias("freq"), F.col("freq").alias("_was"))
        if rounds is not None:
            now, rounds = nxt.drop("_was"), rounds - 1
            continue
        nxt = checkpoint(nxt)
        now = nxt.drop("_was")
        if nxt.where("freq <> _was").isEmpty():
            break
    return weights(now)


def inline(edges: DataFrame, body: DataFrame, sites: DataFrame) -> DataFrame:
    """Each call site gets its own copy of the function it calls.

    ``body(fn, id)`` are the nodes of shared functions, ``sites(fn, site, entry, share)`` the call sites
    with their share of the calls. Copies are named ``node@site``; frequencies are shared out.
    """
    of = body.select("fn", "id")
    both = edges.join(of.select(F.col("fn").alias("_sf"), F.col("id").alias("src")), "src", "left").join(of.select(F.col("fn").alias("_kf"), F.col("id").alias("snk")), "snk", "left")
    name = lambda c: F.concat_ws("@", F.col(c).cast("string"), F.col("site").cast("string"))
    text = lambda c: F.col(c).cast("string")
    site = sites.select(F.col("fn").alias("_fn"), "site", "entry", "share")
    outside = both.where("_sf IS NULL AND _kf IS NULL").select(text("src").alias("src"), text("snk").alias("snk"), F.col("freq").cast("double").alias("freq"))
    calls = both.where("_kf IS NOT NULL AND (_sf IS NULL OR _sf <> _kf)").join(site, (F.col("_kf") == F.col("_fn")) & (F.col("src") == F.col("site")))
    calls = calls.select(text("src").alias("src"), name("snk").alias("snk"), F.col("freq").cast("double").alias("freq"))
    inside = both.where("_sf = _kf").join(site, F.col("_sf") == F.col("_fn")).select(name("src").alias("src"), name("snk").alias("snk"), (F.col("freq") * F.col("share")).alias("freq"))
    leaving = both.where("_sf IS NOT NULL AND (_kf IS NULL OR _sf <> _kf)").join(site, F.col("_sf") == F.col("_fn")).select(name("src").alias("src"), text("snk").alias("snk"), (F.col("freq") * F.col("share")).alias("freq"))
    return weights(outside.unionByName(calls).unionByName(inside).unionByName(leaving).groupBy("src", "snk").agg(F.sum("freq").alias("freq")))


class LocalGraph:
    """A small graph on the driver: ``succ[node][successor] = frequency``. Supernodes have names ``#1, #2, ...``."""

    def __init__(self, edges):
        self.succ, self.pred = defaultdict(dict), defaultdict(dict)
        self.members: dict = {}
        for a, b, f in edges:
            self.succ[a][b] = self.succ[a].get(b, 0) + f
            self.pred[b][a] = self.succ[a][b]

    @classmethod
    def of(cls, edges: DataFrame) -> LocalGraph:
        rows = edges.select("src", "snk", "freq").limit(LOCAL_EDGES + 1).collect()
        if len(rows) > LOCAL_EDGES:
            raise ValueError(f"more than {LOCAL_EDGES} edges: use the DataFrame rules")
        return cls([tuple(r) for r in sorted(rows)])

    def nodes(self) -> list:
        return sorted({n for n in (*self.succ, *self.pred) if self.succ.get(n) or self.pred.get(n)}, key=str)

    def edges(self) -> list[tuple]:
        return sorted(((a, b, f) for a, out in self.succ.items() for b, f in out.items()), key=str)

    def size(self) -> tuple[int, int]:
        return len(self.nodes()), sum(map(len, self.succ.values()))

    def weight(self, a, b) -> float:
        return self.succ[a][b] / sum(self.succ[a].values())

    def weighted(self) -> dict:
        return {a: {b: f / total for b, f in out.items()} for a, out in self.succ.items() if out and (total := sum(out.values()))}

    def contract(self, inside: set):
        """The new supernode's name."""
        name = f"#{len(self.members) + 1}"
        self.members[name] = set(inside)
        for n in inside:
            for m, f in self.succ.pop(n, {}).items():
                self.pred[m].pop(n, None)
                if m not in inside:
                    self.succ[name][m] = self.succ[name].get(m, 0) + f
                    self.pred[m][name] = self.succ[name][m]
            for m, f in self.pred.pop(n, {}).items():
                if m not in inside and n in self.succ.get(m, {}):
                    del self.succ[m][n]
                    self.succ[m][name] = self.succ[m].get(name, 0) + f
                    self.pred[name][m] = self.succ[m][name]
        return name

    def leaves(self, node) -> set:
        """The original nodes under a node."""
        if node not in self.members:
            return {node}
        return set().union(*(self.leaves(n) for n in self.members[node]))

    def chain(self, source) -> set:
        out: set = set()
        while len(self.succ.get(source, ())) == 1:
            (sink,) = self.succ[source]
            if sink in out or sink == source or len(self.pred[sink]) != 1 or len(self.succ.get(sink, ())) != 1 or source in self.succ[sink] or not self.pred.get(source):
                break
            out |= {source, sink}
            source = sink
        return out

    def select(self, source) -> set:
        """A branch whose arms meet again one step later, with or without a direct way."""
        mids = set(self.succ.get(source, ()))
        if len(mids) < 1 or not self.pred.get(source) or source in mids:
            return set()
        onward = {m: set(self.succ.get(m, ())) for m in mids}
        meet, skips = None, False
        common = set.intersection(*onward.values()) if mids else set()
        if all(len(x) == 1 for x in onward.values()) and len(common) == 1:
            (meet,) = common
        else:
            for y in sorted(mids, key=str):
                rest = mids - {y}
                if rest and all(onward[m] == {y} for m in rest):
                    meet, skips, mids = y, True, rest
                    break
        if meet is None or meet == source or meet in mids:
            return set()
        if not self.succ.get(meet) or not self.pred.get(meet) or (set(self.pred[source]) & (mids | {meet})):
            return set()
        if any(set(self.pred[m]) != {source} or set(self.succ[m]) != {meet} or m in self.succ[meet] for m in mids):
            return set()
        if not set(self.pred[meet]) <= mids | ({source} if skips else set()):
            return set()
        return {source, meet} | mids

    def bottleneck(self, source) -> set:
        """Grows a region from ``source`` as long as all ways into each node come from inside, and gives the
        smallest with one entrance and one node that is left by, of three nodes at least and without a cycle."""
        if not self.pred.get(source) or not self.succ.get(source):
            return set()
        inside, grown = {source}, 0
        while grown < REGION:
            ready = sorted({m for n in inside for m in self.succ.get(n, ()) if m not in inside and self.succ.get(m) and set(self.pred[m]) <= inside}, key=str)
            if not ready:
                return set()
            for m in ready:
                inside.add(m)
                grown += len(self.pred[m])
                leaving = {n for n in inside if any(k not in inside for k in self.succ[n])}
                entered = {n for n in inside if any(k not in inside for k in self.pred.get(n, ()))}
                if len(inside) >= 3 and leaving == {m} and entered == {source} and not self._cyclic(inside):
                    return set(inside)
        return set()

    def _cyclic(self, inside: set) -> bool:
        degree = {n: sum(m in inside for m in self.pred.get(n, ())) for n in inside}
        free, seen = [n for n, d in degree.items() if not d], 0
        while free:
            n = free.pop()
            seen += 1
            for m in self.succ.get(n, ()):
                if m in degree:
                    degree[m] -= 1
                    if not degree[m]:
                        free.append(m)
        return seen < len(inside)

    def fan(self, inside: set, source, sink) -> bool:
        """Whether only ``source`` is entered and only ``sink`` left."""
        if len(inside) < 3 or any(not self.pred.get(n) or not self.succ.get(n) for n in inside):
            return False
        return all(n == source or set(self.pred[n]) <= inside for n in inside) and all(n == sink or set(self.succ[n]) <= inside for n in inside)

    def anchor(self, inside: set) -> int:
        return max(sum(self.pred.get(n, {}).values()) for n in inside)

    def boundary(self, inside: set) -> tuple[list, list]:
        entrances = sorted(((m, n) for n in inside for m in self.pred.get(n, ()) if m not in inside), key=str)
        exits = sorted(((n, m) for n in inside for m in self.succ.get(n, ()) if m not in inside), key=str)
        return entrances, exits

    def cycle(self, node, graph: dict | None = None) -> list:
        """The likeliest cycle through a node, in order; empty if there is none."""
        return local_path(self.weighted() if graph is None else graph, node, node)

    def best_cycle(self, node, graph: dict | None = None) -> frozenset:
        return frozenset(self.cycle(node, graph))

    def rare_loops(self) -> bool:
        """Contracts disjoint likeliest cycles of low frequency that have one entrance and one exit."""
        used, changed, graph = set(), False, self.weighted()
        for n in self.nodes():
            inside = set(self.best_cycle(n, graph))
            if not inside or inside & used or len(inside) < 2:
                continue
            entrances, exits = self.boundary(inside)
            if len(entrances) == len(exits) == 1 and self.anchor(inside) < ANCHOR:
                used |= inside
                self.contract(inside)
                changed = True
        return changed

    def level(self) -> bool:
        """Balances nodes with one edge in and one out; one pass in order, later nodes see earlier changes."""
        changed = False
        for n in self.nodes():
            if len(self.pred.get(n, ())) == 1 == len(self.succ.get(n, ())):
                (a,), (b,) = self.pred[n], self.succ[n]
                least = min(self.succ[a][n], self.succ[n][b])
                if self.succ[a][n] != least or self.succ[n][b] != least:
                    self.succ[a][n] = self.pred[n][a] = self.succ[n][b] = self.pred[b][n] = least
                    changed = True
        return changed

    def sweep(self, *rules) -> bool:
        """Applies the first rule that fits at each node, until none does."""
        changed = again = False
        pending = self.nodes()
        while pending:
            n = pending.pop(0)
            if not self.succ.get(n):
                continue
            for rule in rules:
                if len(inside := rule(n)) > 1:
                    v = self.contract(inside)
                    pending = [m for m in pending if m not in inside] + [*sorted(self.pred[v], key=str), v]
                    changed = again = True
                    break
            if not pending and again:
                again, pending = False, self.nodes()
        return changed

    def simplify(self) -> LocalGraph:
        """All rules to a fixpoint."""
        self.level()
        self.sweep(self.chain, self.select)
        while True:
            before = self.size()
            self.sweep(self.chain, self.select, self.bottleneck)
            self.rare_loops()
            self.level()
            if self.size() == before:
                return self


def problems(graph: LocalGraph, entry) -> list[str]:
    """What is wrong with a graph: empty, not reachable from the entry, weights that don't add up."""
    out = [] if graph.nodes() else ["empty"]
    seen, todo = {entry}, [entry]
    while todo:
        for m in graph.succ.get(todo.pop(), ()):
            if m not in seen:
                seen.add(m)
                todo.append(m)
    out += [f"unreachable: {n}" for n in graph.nodes() if n not in seen]
    ends = {n for n in graph.nodes() if not graph.succ.get(n)}
    if ends:
        good, todo = set(ends), list(ends)
        while todo:
            for m in graph.pred.get(todo.pop(), ()):
                if m not in good:
                    good.add(m)
                    todo.append(m)
        out += [f"no way out: {n}" for n in graph.nodes() if n not in good]
    out += [f"weights of {a}" for a, w in graph.weighted().items() if abs(sum(w.values()) - 1) > 1e-4]
    return out
