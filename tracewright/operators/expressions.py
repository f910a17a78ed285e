"""Expressions of values in a def-use graph: one row for each distinct expression, and their printed forms.

``def_use(src, snk)`` leads from an operand to its user, with an optional ``position`` of the operand (else its
name orders the operands); ``insts(inst, op)`` describes instructions, with an optional ``name``: leaves of one name are one expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import settled

#: Rounds after which the frames of the rounds become one; rounds after which uses of named operands leave those that wait.
MERGE, SHRINK = 16, 4


def table(def_use: DataFrame, insts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``inst, expr`` of every value, and ``expr, level, op, args, name`` of every distinct expression.

    An expression is known by the digest of its operator and its operands' digests, so equal parts are one row
    wherever they occur. Leaves (level 0) are values without operands, operands that ``insts`` doesn't have, and phis, which
    stand for what a cycle carries. A round gives the values whose last operand has just been named: what was named in the last round meets the
    uses that still wait; digests named before don't move again. Any other cycle is an error. An operand used twice counts twice.
    """
    key = "position" if "position" in def_use.columns else "src"
    uses = def_use.where("src IS NOT NULL AND snk IS NOT NULL").select(F.col("snk").alias("inst"), F.col("src").alias("arg"), F.col(key).alias("at"))
    label = F.col("name") if "name" in insts.columns else F.lit(None)
    known = insts.where("inst IS NOT NULL").select("inst", "op", F.coalesce(label, F.col("inst").cast("string")).alias("name")).dropDuplicates(["inst"])
    inputs = settled(uses.join(known.where("op = 'phi'").select("inst"), "inst", "left_anti"))
    unknown = uses.select(F.explode(F.array("arg", "inst")).alias("inst")).distinct().join(known.select("inst"), "inst", "left_anti")
    everyone = settled(known.unionByName(unknown.select("inst", F.lit(None).cast("string").alias("op"), F.col("inst").cast("string").alias("name"))))
    total = settled(inputs.groupBy("inst").agg(F.count("*").alias("total")))
    none = F.array().cast("array<string>")
    leaf = everyone.join(total.select("inst"), "inst", "left_anti")
    last = settled(leaf.select("inst", F.sha2(F.concat(F.lit("v"), "name"), 256).alias("expr"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("op"), none.alias("args"), "name"))
    waiting = settled(inputs.join(total, "inst").join(everyone.select("inst", F.coalesce("op", F.lit("?")).alias("op")), "inst"))
    several = bool(total.where("total > 1").head(1))
    partial, merged, fresh, rounds = None, [], [last], 0
    both = lambda frames: (_all(f.select("inst", "expr") for f in frames), _all(f.drop("inst") for f in frames).dropDuplicates(["expr"]))
    while True:
        got = waiting.join(last.select(F.col("inst").alias("arg"), F.col("expr").alias("of")), "arg").select("inst", "op", "total", "at", "of")
        made = got.where("total = 1").select("inst", "op", F.array("of").alias("args"))
        if several:
            got = settled(got)
            made = got.where("total = 1").select("inst", "op", F.array("of").alias("args"))
            parts = got.where("total > 1")
            parts = parts if partial is None else parts.unionByName(partial)
            held = settled(parts.groupBy("inst", "op", "total").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("at", "of"))).alias("a")))
            made = made.unionByName(held.where("n = total").select("inst", "op", F.transform("a", lambda x: x["of"]).alias("args")))
            partial = held.where("n < total").select("inst", "op", "total", F.inline("a"))
        rounds += 1
        last = settled(made.select("inst", F.sha2(F.concat("op", F.lit("("), F.array_join("args", ","), F.lit(")")), 256).alias("expr"), F.lit(rounds).alias("level"), "op", "args", F.lit(None).cast("string").alias("name")))
        if last.isEmpty():
            break
        fresh.append(last)
        if rounds % SHRINK == 0:
            named = _all(f.select(F.col("inst").alias("arg")) for f in fresh[-SHRINK - 1 : -1])
            waiting = settled(waiting.join(named, "arg", "left_anti"))
        if len(fresh) == MERGE:
            merged, fresh = [*merged, tuple(map(settled, both(fresh[:-SHRINK])))], fresh[-SHRINK:]
    merged = [*merged, both(fresh)]
    of, exprs = _all(m[0] for m in merged), _all(m[1] for m in merged)
    if of.count() < everyone.count():
        raise ValueError("values without a phi lead back to themselves")
    return of, exprs.dropDuplicates(["expr"])


def _all(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def printed(exprs: DataFrame, shared: bool = False) -> DataFrame:
    """``expr, text`` of a table of expressions, one join a level: ``op(first, second)``, leaves as ``v`` and their name.

    A text holds each part as often as it occurs, which may double with each level. With ``shared`` an operand that occurs more
    than once in the table stands as ``$`` and its digest instead; its own row holds what it is.
    """
    rows = settled(exprs)
    parts = rows.select("expr", "level", "op", F.posexplode("args").alias("at", "arg"))
    often = settled(parts.groupBy("arg").agg(F.count("*").alias("n")).where("n > 1").select("arg", F.lit(True).alias("often")))
    text = settled(rows.where("level = 0").select("expr", F.concat(F.lit("v"), "name").alias("text")))
    top = rows.agg(F.max("level")).first()[0] or 0
    for level in range(1, top + 1):
        here = parts.where(F.col("level") == level).join(text.select(F.col("expr").alias("arg"), F.col("text").alias("t")), "arg")
        if shared:
            named = F.col("often") & ~F.col("t").startswith("v")
            here = here.join(often, "arg", "left").withColumn("t", F.when(named, F.concat(F.lit("$"), "arg")).otherwise(F.col("t")))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), ", ")
        made = here.groupBy("expr", "op").agg(joined.alias("j")).select("expr", F.concat("op", F.lit("("), "j", F.lit(")")).alias("text"))
        text = text.unionByName(settled(made))
        if level % MERGE == 0:
            text = settled(text)
    return settled(text)
