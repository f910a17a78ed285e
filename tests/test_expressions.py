"""Expression tables against plain recursion."""

import random

import pytest

from tracewright.operators import dataflow, expressions


def graph(spark, seed, n=40):
    r = random.Random(seed)
    ops = {i: r.choice(["add", "mul", "phi"]) if i > 4 else "load" for i in range(n)}
    uses = [(r.randrange(max(0, i - 9), i), i, k) for i in range(5, n) for k in range(r.randrange(3))]
    uses += [(i, i - r.randrange(3), 9) for i in range(5, n) if ops[i] == "phi"]  # what a phi takes from later values
    uses = [(s, d, k) for s, d, k in uses if s < d or ops.get(d) == "phi"]
    names = {i: "xy"[i % 2] if i < 5 else None for i in range(n)}
    frames = spark.createDataFrame(uses, "src int, snk int, position int"), spark.createDataFrame([(i, ops[i], names[i]) for i in range(n)], "inst int, op string, name string")
    return ops, uses, names, *frames


def plain(ops, uses, names):
    args = {}
    for s, d, k in sorted(uses, key=lambda u: u[2]):
        args.setdefault(d, []).append(s)

    def text(i):
        if ops[i] == "phi" or i not in args:
            return f"v{names[i] or i}"
        return f"{ops[i]}({', '.join(map(text, args[i]))})"

    return {i: text(i) for i in ops}


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, seed):
    ops, uses, names, du, insts = graph(spark, seed)
    of, exprs = expressions.table(du, insts)
    texts = {r.inst: r.text for r in of.join(expressions.printed(exprs), "expr").collect()}
    want = plain(ops, uses, names)
    assert texts == want
    assert exprs.count() == len(set(want.values()))

    own = {r.expr: r.text for r in expressions.printed(exprs, shared=True).collect()}

    def open_(t):
        while "$" in t:
            at = t.index("$")
            t = t[:at] + own[t[at + 1 : at + 65]] + t[at + 65 :]
        return t

    assert {r.inst: open_(own[r.expr]) for r in of.collect()} == want


def test_deep_and_doubled(spark):
    """Twelve levels whose text would hold 4,096 leaves take thirteen rows; a long chain isn't cut."""
    du = spark.createDataFrame([(i, i + 1) for i in range(12)] * 2, "src int, snk int")
    insts = spark.createDataFrame([(i, "add") for i in range(13)], "inst int, op string")
    of, exprs = expressions.table(du, insts)
    assert exprs.count() == 13
    assert all(len(r.text) < 150 for r in expressions.printed(exprs, shared=True).collect())
    chain = du.distinct()
    (row,) = dataflow.expressions(chain, insts, spark.createDataFrame([(12,)], "inst int")).collect()
    assert row.text == "add(" * 12 + "v0" + ")" * 12


def test_cycles_and_nothing(spark):
    insts = spark.createDataFrame([(1, "add"), (2, "add")], "inst int, op string")
    with pytest.raises(ValueError):
        expressions.table(spark.createDataFrame([(1, 2), (2, 1)], "src int, snk int"), insts)
    none = spark.createDataFrame([], "src int, snk int")
    assert {r.text for r in expressions.printed(expressions.table(none, insts)[1]).collect()} == {"v1", "v2"}
    assert expressions.table(none, insts.limit(0))[1].isEmpty()
    of, exprs = expressions.table(spark.createDataFrame([(7, 1), (None, 2)], "src int, snk int"), insts)
    assert {r.inst: r.text for r in of.join(expressions.printed(exprs), "expr").collect()} == {7: "v7", 1: "add(v7)", 2: "v2"}


def test_operands_named_many_rounds_apart(spark):
    """Forty levels of a chain, each third with a leaf or an early value as another operand: over the rounds that merge frames and drop settled uses."""
    r = random.Random(3)
    uses = [(i, i + 1, 0) for i in range(40)] + [(r.randrange(i), i + 1, 1) for i in range(2, 40, 3)] + [(100 + i, 101 + i, 0) for i in range(20)]
    du = spark.createDataFrame(uses, "src int, snk int, position int")
    ids = sorted({i for u in uses for i in u[:2]})
    insts = spark.createDataFrame([(i, "add", "x" if i in (0, 100) else None) for i in ids], "inst int, op string, name string")
    of, exprs = expressions.table(du, insts)
    level, want = {0: 0, 100: 0}, {0: "x", 100: "x"}
    for i in ids:
        args = [s for s, d, _ in sorted(uses, key=lambda u: u[2]) if d == i]
        if args:
            level[i], want[i] = max(level[a] for a in args) + 1, ("add", *(want[a] for a in args))
    rows = of.join(exprs, "expr").collect()
    assert {x.inst: x.level for x in rows} == level
    same = {}
    for x in rows:
        assert same.setdefault(x.expr, want[x.inst]) == want[x.inst]
    assert len(same) == len(set(want.values())) == exprs.count()
