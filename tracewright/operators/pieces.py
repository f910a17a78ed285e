"""Rewrites of a graph that comes in pieces: each small piece is rewritten by one task in one pass, with the rules of ``regions.simplify``.

All edges out of a node lie in one piece, and a node of several pieces has none out. No rule takes such an end into a set, so what the pieces
become doesn't depend on each other; parents alone are numbered by the rounds of their piece.

``parts(piece, n, part)`` are rows of a piece, with ``n`` edges in all (an upper bound will do) and some of them as an array ``part`` of ``src, snk, freq``,
in partitions by ``piece``. A piece of more than ``PIECE`` edges takes the distributed form.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import contraction, regions
from .rewrite import ANCHOR, REGION

# Tasks get the rules with the plan: workers need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Edges of a piece that one task rewrites at once.
PIECE = 2_000


class Piece:
    """``succ[node][successor] = frequency``, and the nodes that lead to each; ``under``, ``blocks`` and ``least`` of each parent."""

    def __init__(self, g: dict):
        self.original, self.rounds, self.under, self.blocks, self.least = g, 0, {}, {}, {}
        succ: dict = {}
        for (a, b), f in g.items():
            if a in succ:
                succ[a][b] = f
            else:
                succ[a] = {b: f}
        self._around(succ)

    def _around(self, succ: dict) -> None:
        self.succ, self.pred = succ, {}
        pred = self.pred
        for a, out in succ.items():
            for b in out:
                if b in pred:
                    pred[b].append(a)
                else:
                    pred[b] = [a]

    def edges(self) -> dict:
        return {(a, b): f for a, out in self.succ.items() for b, f in out.items()}

    def put_together(self, sets: list, kind_entry: bool) -> None:
        """``sets`` of (name, ids); with ``kind_entry`` the name is the node that the set is entered at."""
        self.rounds += 1
        to: dict = {}
        entries = set()
        for name, ids in sets:
            parent = f"{name}@{self.rounds}"
            for i in ids:
                to[i] = parent
            if kind_entry:
                entries.add(name)
            self.under[parent] = list(ids)
            self.blocks[parent] = sum(self.blocks.get(i, 1) for i in ids)
            self.least[parent] = min(self.least.get(i, i) for i in ids)
        succ: dict = {}
        for a, out in self.succ.items():
            c = to.get(a)
            if c is None:
                row = succ[a] = {}
            else:
                row = succ.setdefault(c, {})
            for b, f in out.items():
                d = to.get(b)
                if d is None:
                    d = b
                elif d == c and b not in entries:
                    continue
                row[d] = row[d] + f if d in row else f
        self._around({a: out for a, out in succ.items() if out})

    def chains(self) -> list:
        succ, pred = self.succ, self.pred
        link = {}
        for a, out in succ.items():
            if len(out) == 1 and a in pred:
                (b,) = out
                if len(pred[b]) == 1 and len(succ.get(b, ())) == 1 and a not in succ[b]:
                    link[a] = b
        if not link:
            return []
        sets, seen = [], set()
        for head in link.keys() - set(link.values()):
            ids = [head]
            while ids[-1] in link:
                ids.append(link[ids[-1]])
            seen.update(ids)
            sets.append((head, ids))
        for a in sorted(link.keys() - seen):  # rings
            if a not in seen:
                ids = [a]
                while link[ids[-1]] != a:
                    ids.append(link[ids[-1]])
                seen.update(ids)
                sets.append((a, ids))
        return sets

    def region(self, s: str) -> tuple | None:
        """Edges and nodes of the smallest region that ``s`` alone enters: a node joins when all that lead to it are in."""
        succ, pred = self.succ, self.pred
        inside, met, fresh, edges, leaving = {s}, {}, [s], 0, len(succ[s])
        if leaving > REGION:
            return None
        while True:
            ready = []
            for n in fresh:
                for m in succ[n]:
                    if m not in inside:
                        got = met[m] = met.get(m, 0) + 1
                        if got == len(pred[m]) and got <= REGION and m in succ:
                            ready.append(m)
            if not ready:
                return None
            inside.update(ready)
            for m in ready:
                edges += len(pred[m])
            # All that the others lead to has joined, and somebody else leads to the entry.
            if len(ready) == 1 and leaving == edges >= 3 and len(pred[s]) > (s in succ[ready[0]]):
                return edges, inside
            for m in ready:
                leaving += len(succ[m])
            if leaving > REGION:
                return None
            fresh = ready

    def regions(self) -> list:
        succ, pred = self.succ, self.pred
        found, later = {}, []
        for s, out in succ.items():
            if s not in pred:
                continue
            ways = [m for m in out if len(pred[m]) == 1 and m != s]  # else nothing can join
            if len(out) == 1 and ways and len(succ.get(ways[0], ())) > 1:
                later.append((s, ways[0]))
            elif ways and (r := self.region(s)):
                found[s] = r
        for s, m in later:
            # Its only successor's region would lie in its own and come first: chosen or not, it keeps this one from being chosen.
            if m not in found and (r := self.region(s)):
                found[s] = r
        return _independent(sorted(((n, s, ids) for s, (n, ids) in found.items()), key=lambda x: x[:2]))

    def _cyclic(self) -> bool:
        """Whether there is a cycle of two nodes or more."""
        wait = {b: len(p) - (b in p) for b, p in self.pred.items()}
        free = [a for a in self.succ if not wait.get(a)]
        seen = 0
        while free:
            a = free.pop()
            seen += 1
            for b in self.succ.get(a, ()):
                if b != a:
                    wait[b] -= 1
                    if not wait[b]:
                        free.append(b)
        return seen < len(self.succ.keys() | self.pred.keys())

    def _cycle(self, s: str, weight: dict) -> list:
        """Nodes of the likeliest cycle through ``s``; of equal paths the shorter, then the one of least last step."""
        best = {b: (w, s) for b, w in weight[s].items()}
        fresh = set(best)
        while fresh:
            tried: dict = {}
            for a in sorted(fresh - {s}):
                if s in best and best[a][0] <= best[s][0]:
                    continue
                for b, w in weight.get(a, {}).items():
                    p = best[a][0] * w
                    if b not in tried or (-p, a) < (-tried[b][0], tried[b][1]):
                        tried[b] = p, a
            fresh = {b for b, (p, _) in tried.items() if b not in best or p > best[b][0]}
            best.update((b, tried[b]) for b in fresh)
        if s not in best:
            return []
        path = [s]
        while best[path[-1]][1] != s:
            path.append(best[path[-1]][1])
        return path

    def rare_loops(self) -> list:
        if not self._cyclic():
            return []
        succ, pred = self.succ, self.pred
        into = {b: sum(succ[a][b] for a in p) for b, p in pred.items()}
        rare = {b for b, f in into.items() if f < ANCHOR}
        near = [(a, b) for a in rare & succ.keys() for b in succ[a] if a != b and b in rare]
        weight = {a: {b: f / total for b, f in out.items()} for a, out in succ.items() if (total := sum(out.values()))}
        found = []
        for s in sorted({a for a, _ in near} & {b for _, b in near}):
            ids = set(self._cycle(s, weight))
            if len(ids) > 1 and sum(a not in ids for b in ids for a in pred[b]) == 1 and sum(b not in ids for a in ids for b in succ[a]) == 1 and max(into[b] for b in ids) < ANCHOR:
                found.append(((), s, ids))
        return _independent(found)

    def level(self) -> None:
        thin = sorted(a for a, out in self.succ.items() if len(out) == 1 and len(self.pred.get(a, ())) == 1)
        changed = len({f for out in self.succ.values() for f in out.values()}) > 1
        while changed:
            changed = False
            for n in thin:
                (a,), (b,) = self.pred[n], self.succ[n]
                low = min(self.succ[a][n], self.succ[n][b])
                changed |= self.succ[a][n] != low or self.succ[n][b] != low
                self.succ[a][n] = self.succ[n][b] = low

    def simplify(self) -> Piece:
        self.level()
        while True:
            before = self.rounds
            while True:
                if sets := self.chains():
                    self.put_together(sets, True)
                if not (sets := self.regions()):
                    break
                self.put_together(sets, True)
            while sets := self.rare_loops():
                self.put_together(sets, False)
            if self.rounds == before:
                return self
            self.level()

    def opened(self, chosen: set) -> dict:
        """The original edges between the highest parents that are not ``chosen``, and below all that are."""
        shut = {c: p for p, ids in self.under.items() if p not in chosen for c in ids}
        out: dict = defaultdict(int)
        for (a, b), f in self.original.items():
            ends = []
            for n in (a, b):
                while n in shut:
                    n = shut[n]
                ends.append(n)
            out[tuple(ends)] += f
        return dict(out)


def _independent(sets: list) -> list:
    """(name, ids) of sorted (order, name, ids) that share no id with one before."""
    used, out = set(), []
    for _, name, ids in sets:
        if used.isdisjoint(ids):
            used |= ids
            out.append((name, ids))
    return out


def _shrunk(g: dict) -> Iterator[tuple]:
    now = Piece(g).simplify()
    for a, out in now.succ.items():
        for b, f in out.items():
            yield a, b, f, now.blocks.get(b), now.least.get(b)


def _undone(g: dict) -> Iterator[tuple]:
    now = Piece(g).simplify()
    back = now.opened(set(now.under))
    total: dict = defaultdict(int)
    for (a, _), f in back.items():
        total[a] += f
    for (a, b), f in back.items():
        yield a, b, f, f / total[a]


def _rows(rule: Callable, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``rule`` over each piece of a partition that is sorted by pieces; a piece may begin in one batch and end in another."""
    at, g, out = None, {}, []

    def batch() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for b in batches:
        part = b.column("part")
        starts = part.offsets.to_pylist()
        src, snk, freq = (c.to_pylist() for c in part.flatten().flatten())
        for i, piece in enumerate(b.column("piece").to_pylist()):
            if piece != at:
                out.extend(rule(g))
                at, g = piece, {}
            for j in range(starts[i] - starts[0], starts[i + 1] - starts[0]):
                key = src[j], snk[j]
                g[key] = g.get(key, 0) + freq[j]
        if out:
            yield batch()
            out = []
    out.extend(rule(g))
    yield batch()


def _each(parts: DataFrame, rule: Callable, more: str, arrow: list) -> DataFrame:
    schema = pa.schema([("src", pa.string()), ("snk", pa.string()), ("freq", pa.int64()), *arrow])
    few = parts.where(F.col("n") <= PIECE).select("piece", "part").sortWithinPartitions("piece")
    return few.mapInArrow(partial(_rows, rule, schema), f"src string, snk string, freq long, {more}")


def _large(parts: DataFrame, most: int | None) -> DataFrame | None:
    most = parts.agg(F.max("n")).first()[0] if most is None else most
    return parts.where(F.col("n") > PIECE).select(F.inline("part")) if (most or 0) > PIECE else None


def simplify_whole(edges: DataFrame) -> DataFrame:
    """As ``simplify``, by the distributed form, for any graph ``edges(src, snk, freq)``."""
    now = regions.simplify(contraction.begin(edges))
    return now.edges.select("src", "snk", "freq").join(contraction.sizes(now), F.col("snk") == F.col("top"), "left").drop("top")


def undone_whole(edges: DataFrame) -> DataFrame:
    """As ``undone``, by the distributed form, for any graph ``edges(src, snk, freq)``."""
    return contraction.expanded(regions.simplify(contraction.begin(edges)))


def simplify(parts: DataFrame, most: int | None = None) -> DataFrame:
    """``src, snk, freq, blocks, least``: the graph after all rules; of a parent that is led to the number of original nodes under it and the least of them.

    ``most``, the greatest ``n``, is looked for if it is not given.
    """
    done, large = _each(parts, _shrunk, "blocks long, least string", [("blocks", pa.int64()), ("least", pa.string())]), _large(parts, most)
    return done if large is None else done.unionByName(simplify_whole(large))


def undone(parts: DataFrame, most: int | None = None) -> DataFrame:
    """``src, snk, freq, weight``: the graph after all rules, and after all its parents were opened again from the log; original frequencies."""
    done, large = _each(parts, _undone, "weight double", [("weight", pa.float64())]), _large(parts, most)
    return done if large is None else done.unionByName(undone_whole(large))
