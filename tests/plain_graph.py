"""Plain forms of the graph rules, over ``{(src, snk): freq}`` with node names as text."""

from __future__ import annotations

import random
from collections import defaultdict


def random_union(seed, parts=25, nodes=9):
    """Many small graphs as one: an entry, a body with branches and loops, an exit each; frequencies rare and frequent."""
    rng = random.Random(seed)
    g = {}
    for k in range(parts):
        n = rng.randrange(4, nodes)
        top = rng.choice((4, 60))
        pairs = [(i, i + 1) for i in range(n)] + [(rng.randrange(1, n), rng.randrange(1, n)) for _ in range(rng.randrange(n))]
        for a, b in pairs:
            g[f"{k:02}.{a}", f"{k:02}.{b}"] = rng.randrange(1, top)
    return g


def around(g):
    succ, pred = defaultdict(set), defaultdict(set)
    for a, b in g:
        succ[a].add(b)
        pred[b].add(a)
    return succ, pred


def weighted(g):
    total = defaultdict(int)
    for (a, _), f in g.items():
        total[a] += f
    return {(a, b): f / total[a] for (a, b), f in g.items()}


def chain_sets(g):
    succ, pred = around(g)
    link = {a: b for a, b in g if len(succ[a]) == 1 and len(pred[b]) == 1 and len(succ[b]) == 1 and pred[a] and (b, a) not in g}
    heads = sorted(set(link) - set(link.values()))
    sets, seen = [], set()
    for head in heads:
        ids = [head]
        while ids[-1] in link:
            ids.append(link[ids[-1]])
        seen |= set(ids)
        sets.append((head, ids, head))
    for a in sorted(link):
        if a not in seen:
            ids = [a]
            while link[ids[-1]] != a:
                ids.append(link[ids[-1]])
            seen |= set(ids)
            sets.append((a, ids, a))
    return sets


def region(g, succ, pred, s, most=200):
    if not succ[s] or not pred[s] or len(succ[s]) > most:
        return None
    inside, edges, leaving = {s}, 0, len(succ[s])
    while True:
        ready = {m for n in inside for m in succ[n] if m != s and m not in inside and succ[m] and len(pred[m]) <= most and pred[m] <= inside}
        if not ready:
            return None
        edges += sum(len(pred[m]) for m in ready)
        inside |= ready
        if len(ready) == 1:
            (last,) = ready
            others = all(succ[n] <= inside - {s} for n in inside - {last})
            if others and edges >= 3 and pred[s] - inside:
                return edges, inside
        leaving += sum(len(succ[m]) for m in ready)
        if leaving > most:
            return None


def independent(sets):
    """Of (order, name, ids, ...) in order those that share no id with one before."""
    used, out = set(), []
    for s in sorted(sets, key=lambda s: (s[0], s[1])):
        if not used & set(s[2]):
            used |= set(s[2])
            out.append(s)
    return out


def regions(g):
    succ, pred = around(g)
    found = [(r[0], s, r[1]) for s in sorted({*succ, *pred}) if (r := region(g, succ, pred, s))]
    return [(name, ids, name) for _, name, ids in independent(found)]


def cycles(g, sources):
    """{source: (prob, nodes along the cycle from it)}: in rounds; of equal paths the shorter, then the one of least last step."""
    w, (succ, _) = weighted(g), around(g)
    out = {}
    for s in sources:
        best = {b: (w[s, b], s) for b in succ[s]}
        fresh = set(best)
        while fresh:
            tried = {}
            for a in sorted(fresh - {s}):
                if s in best and best[a][0] <= best[s][0]:
                    continue
                for b in succ[a]:
                    p = best[a][0] * w[a, b]
                    if b not in tried or (-p, a) < (-tried[b][0], tried[b][1]):
                        tried[b] = p, a
            fresh = {b for b, (p, _) in tried.items() if b not in best or p > best[b][0]}
            best |= {b: tried[b] for b in fresh}
        if s in best:
            path = [s]
            while best[path[-1]][1] != s:
                path.append(best[path[-1]][1])
            out[s] = best[s][0], [s, *reversed(path[1:])]
    return out


def boundary(g, ids):
    ids, into = set(ids), defaultdict(int)
    for (_, b), f in g.items():
        into[b] += f
    return sum(b in ids and a not in ids for a, b in g), sum(a in ids and b not in ids for a, b in g), max(into[n] for n in ids)


def rare_loops(g):
    into = defaultdict(int)
    for (_, b), f in g.items():
        into[b] += f
    rare = {n for n, f in into.items() if f < 16}
    near = [(a, b) for a, b in g if a != b and a in rare and b in rare]
    found = cycles(g, {a for a, _ in near} & {b for _, b in near})
    good = [((), s, path) for s, (_, path) in found.items() if len(path) > 1 and (x := boundary(g, path))[:2] == (1, 1) and x[2] < 16]
    return [(name, ids, None) for _, name, ids in independent(good)]


class Graph:
    def __init__(self, g):
        self.g, self.rounds, self.log, self.under = dict(g), 0, [], {}

    def blocks(self, node):
        return {node} if node not in self.under else set().union(*map(self.blocks, self.under[node]))

    def put_together(self, sets, kind, **more):
        self.rounds += 1
        to, entries = {}, set()
        for name, ids, entry in sets:
            parent = f"{name}@{self.rounds}"
            to |= dict.fromkeys(ids, parent)
            entries.add(entry)
            self.under[parent] = set(ids)
            self.log.append((kind, parent, more.get("of", {}).get(name)))
        new = defaultdict(int)
        for (a, b), f in self.g.items():
            if a in to and to[a] == to.get(b) and b not in entries:
                continue
            new[to.get(a, a), to.get(b, b)] += f
        self.g = dict(new)

    def level(self):
        changed = True
        while changed:
            changed = False
            succ, pred = around(self.g)
            for n in sorted({*succ, *pred}):
                if len(succ[n]) == 1 == len(pred[n]):
                    (a,), (b,) = pred[n], succ[n]
                    low = min(self.g[a, n], self.g[n, b])
                    for e in ((a, n), (n, b)):
                        changed |= self.g[e] != low
                        self.g[e] = low

    def simplify(self):
        self.level()
        while True:
            before = self.rounds
            while True:
                if sets := chain_sets(self.g):
                    self.put_together(sets, "chain")
                if not (sets := regions(self.g)):
                    break
                self.put_together(sets, "region")
            while sets := rare_loops(self.g):
                self.put_together(sets, "loop")
            if self.rounds == before:
                return self
            self.level()

    def kernels(self, least=False):
        self.simplify()
        while True:
            found = {}
            for s, (p, path) in sorted(cycles(self.g, {a for a, _ in self.g}).items()):
                at = {n: i for i, n in enumerate(path)}
                other = any(a in at and b in at and (0 < at[b] <= at[a] or at[a] == at[b] == 0) for a, b in self.g)
                entrances, exits, anchor = boundary(self.g, path)
                if (other and len(path) > 1) or not entrances or not exits or anchor < 16:
                    continue
                key = frozenset(path)
                old = found.get(key)
                found[key] = (entrances + exits, -max(p, -old[1] if old else 0.0), min(path), old[3] if old else s)
            if not found:
                return self
            fewest = min(x[0] for x in found.values())
            sets = [(x[:3], x[3], sorted(ids)) for ids, x in found.items() if not least or x[0] == fewest]
            chosen = independent(sets)
            self.put_together([(name, ids, None) for _, name, ids in chosen], "kernel", of={name: -order[1] for order, name, _ in chosen})
            self.simplify()

    def kernel_rows(self):
        """(blocks, probability, blocks of the next kernel around it) of those that aren't dropped."""
        found = {p: (self.blocks(p), x) for kind, p, x in self.log if kind == "kernel"}
        above = {}
        for p, (b, _) in found.items():
            around_ = [q for q, (c, _) in found.items() if q != p and b <= c and self.holds(q, p)]
            above[p] = min(around_, key=lambda q: sum(self.holds(q, r) for r in around_ if r != q), default=None)
        while True:
            children = {p: [c for c in found if above[c] == p] for p in found}
            gone = [p for p in found if above[p] is None and 2 <= len(children[p]) < 5 and all(children[c] for c in children[p])]
            if not gone:
                break
            for p in gone:
                del found[p]
            above = {p: None if q in gone else q for p, q in above.items() if p in found}
        return sorted((sorted(b), round(x, 9), sorted(found[above[p]][0]) if above[p] else []) for p, (b, x) in found.items())

    def holds(self, outer, inner):
        return any(c == inner or self.holds(c, inner) for c in self.under.get(outer, ()) if c in self.under)
