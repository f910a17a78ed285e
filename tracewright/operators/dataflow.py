"""Classification of tasks over a def-use graph: slices, colours, reductions and the label table.

``def_use(src, snk)`` leads from a value to its users; ``insts(inst, op, block)`` describes instructions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .expressions import printed, table
from .iterate import components
from .paths import reachable

#: Least allocation that makes a base pointer; operators that may reduce.
ALLOCATION = 128
REDUCING = ("add", "fadd", "mul", "fmul", "and", "or", "xor", "fmuladd")


def slice_back(def_use: DataFrame, roots: DataFrame) -> DataFrame:
    return reachable(def_use, roots, backward=True)


def slice_forward(def_use: DataFrame, roots: DataFrame) -> DataFrame:
    return reachable(def_use, roots)


def _of(insts: DataFrame, *ops: str) -> DataFrame:
    return insts.where(F.col("op").isin(*ops)).select(F.col("inst").alias("id"))


def function_nodes(insts: DataFrame, def_use: DataFrame) -> DataFrame:
    """Values between loads and stores."""
    return slice_back(def_use, _of(insts, "store")).join(slice_forward(def_use, _of(insts, "load")), "id", "left_semi")


def state_nodes(insts: DataFrame, def_use: DataFrame, exits: DataFrame) -> DataFrame:
    """What branches that can leave the cycle (``exits(inst)``) depend on."""
    return slice_back(def_use, exits.select(F.col("inst").alias("id")))


def memory_nodes(def_use: DataFrame, pointers: DataFrame) -> DataFrame:
    """What pointer operands (``pointers(inst)``) depend on."""
    return slice_back(def_use, pointers.select(F.col("inst").alias("id")))


def colours(insts: DataFrame, function: DataFrame, state: DataFrame, memory: DataFrame) -> DataFrame:
    """``inst, colour``: state before memory before function; None for the others."""
    ranked = state.select("id", F.lit(0).alias("r")).unionByName(memory.select("id", F.lit(1).alias("r"))).unionByName(function.select("id", F.lit(2).alias("r"))).groupBy("id").agg(F.min("r").alias("r"))
    name = F.when(F.col("r") == 0, "State").when(F.col("r") == 1, "Memory").when(F.col("r") == 2, "Function").otherwise("None")
    return insts.select("inst").join(ranked, F.col("inst") == F.col("id"), "left").select("inst", name.alias("colour"))


def cycle_exits(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``cycle, src, snk``: edges that leave a cycle's blocks ``members(cycle, block)``."""
    out = edges.select("src", "snk").join(members.select("cycle", F.col("block").alias("src")), "src")
    return out.join(members.select("cycle", F.col("block").alias("snk")), ["cycle", "snk"], "left_anti").select("cycle", "src", "snk")


def tasks(cycles: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """``cycle, task, is_top, is_leaf``: components of the cycle hierarchy, named by their topmost cycle of least id."""
    ids = cycles.select(F.col("cycle").alias("id")).distinct()
    group = components(ids, hierarchy.select(F.col("parent").alias("a"), F.col("child").alias("b")))
    top = ids.join(hierarchy.select(F.col("child").alias("id")).distinct(), "id", "left_anti").withColumn("top", F.lit(True))
    leaf = ids.join(hierarchy.select(F.col("parent").alias("id")).distinct(), "id", "left_anti").withColumn("leaf", F.lit(True))
    all_ = group.join(top, "id", "left").join(leaf, "id", "left")
    name = F.min(F.when(F.col("top"), F.col("id"))).over(W.partitionBy("root"))
    return all_.select(F.col("id").alias("cycle"), F.coalesce(name, F.col("root")).alias("task"), F.coalesce("top", F.lit(False)).alias("is_top"), F.coalesce("leaf", F.lit(False)).alias("is_leaf"))


def significant(insts: DataFrame, seen: DataFrame) -> DataFrame:
    """Memory instructions that were part of a hot instance."""
    return insts.where("op IN ('load', 'store')").join(seen.select("inst"), "inst", "left_semi")


def base_pointers(insts: DataFrame, def_use: DataFrame, allocations: DataFrame) -> DataFrame:
    """``inst, bytes``: allocations of at least ALLOCATION bytes that a load or store can come from; ``allocations(inst, bytes)``."""
    back = slice_back(def_use, _of(insts, "load", "store"))
    return allocations.where(F.col("bytes") >= ALLOCATION).join(back.withColumnRenamed("id", "inst"), "inst", "left_semi")


def induction(samples: DataFrame) -> DataFrame:
    """``var, lo, hi, stride`` of observed values ``samples(var, seq, value)``: range and least step between successive values."""
    w = W.partitionBy("var").orderBy("seq")
    step = samples.withColumn("step", F.abs(F.col("value") - F.lag("value").over(w)))
    return step.groupBy("var").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.min(F.when(F.col("step") > 0, F.col("step"))).alias("stride"))


def shared_space(left: DataFrame, right: DataFrame) -> DataFrame:
    """Intersections of index spaces ``var, lo, hi, stride`` with the same ``base``: greatest low, least high, least stride."""
    r = right.select("base", *(F.col(c).alias(f"r_{c}") for c in ("var", "lo", "hi", "stride")))
    met = left.join(r, "base").where((F.greatest("lo", "r_lo") <= F.least("hi", "r_hi")) & (F.col("var") < F.col("r_var")))
    return met.select("base", "var", "r_var", F.greatest("lo", "r_lo").alias("lo"), F.least("hi", "r_hi").alias("hi"), F.least("stride", "r_stride").alias("stride"))


def collections(accesses: DataFrame) -> DataFrame:
    """``base, vars, dims``: the ordered index variables ``accesses(base, position, var)`` of each base pointer."""
    ordered = F.array_sort(F.collect_set(F.struct("position", "var")))
    return accesses.groupBy("base").agg(ordered.alias("o")).select("base", F.transform("o", lambda x: x["var"]).alias("vars"), F.size("o").cast("long").alias("dims"))


def reductions(insts: DataFrame, def_use: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """``phi, op_inst, op``: a phi and a reducing operator that use each other; with ``memory(load, store, pointer_in, pointer_out, indexed)`` also a load
    and a store of one pointer that the cycle doesn't move, around such an operator."""
    ops = insts.where(F.col("op").isin(*REDUCING)).select(F.col("inst").alias("op_inst"), "op")
    phis = insts.where("op = 'phi'").select(F.col("inst").alias("phi"))
    there = def_use.select(F.col("src").alias("phi"), F.col("snk").alias("op_inst"))
    back = def_use.select(F.col("snk").alias("phi"), F.col("src").alias("op_inst"))
    found = there.join(back, ["phi", "op_inst"]).join(phis, "phi").join(ops, "op_inst").select("phi", "op_inst", "op").distinct()
    if memory is None:
        return found
    fixed = memory.where("pointer_in = pointer_out AND NOT indexed").select("load", "store")
    through = fixed.join(def_use.select(F.col("src").alias("load"), F.col("snk").alias("op_inst")), "load").join(def_use.select(F.col("src").alias("op_inst"), F.col("snk").alias("store")), ["op_inst", "store"])
    return found.unionByName(through.join(ops, "op_inst").select(F.col("load").alias("phi"), "op_inst", "op")).distinct()


def serial_reductions(found: DataFrame, def_use: DataFrame) -> DataFrame:
    """Reductions whose running value is used by something besides its own operator."""
    others = def_use.join(found.select(F.col("phi").alias("src"), "op_inst"), "src").where("snk <> op_inst").select(F.col("src").alias("phi")).distinct()
    return found.join(others, "phi", "left_semi")


def parallel_cycles(cycles: DataFrame, overlapping: DataFrame, serial: DataFrame) -> DataFrame:
    """``cycle`` less those of overlapping dimensions and of serial reductions."""
    return cycles.select("cycle").distinct().join(overlapping.select("cycle").unionByName(serial.select("cycle")), "cycle", "left_anti")


def expressions(def_use: DataFrame, insts: DataFrame, roots: DataFrame) -> DataFrame:
    """``inst, text``: printed expression of each root, at any depth; leaves are values without operands and phis."""
    needed = reachable(def_use, roots.select(F.col("inst").alias("id")), backward=True).select(F.col("id").alias("snk"))
    of, exprs = table(def_use.join(needed, "snk", "left_semi"), insts.join(roots.select("inst").unionByName(needed.select(F.col("snk").alias("inst"))), "inst", "left_semi"))
    return of.join(roots.select("inst"), "inst", "left_semi").join(printed(exprs), "expr").select("inst", "text")


def task_label(features: DataFrame) -> DataFrame:
    """``task, label`` from ``inputs, outputs, input_dims array<int>, reduction, in_place, parallel``: one conditional expression, no lookup join."""
    n, red = F.col("inputs"), F.col("reduction")
    made = ~F.col("in_place") & (F.col("outputs") == 1)
    label = (
        F.when(~F.col("parallel"), "NotParallel")
        .when((n <= 1) & red, "Stencil")
        .when(n == 0, "Init")
        .when(n == 1, F.when(F.col("in_place"), "Foreach").otherwise("Map"))
        .when((n == 2) & ~red, "ZIP")
        .when(n == 2, F.when(F.array_contains("input_dims", 1), "GEMV").otherwise("GEMM"))
        .when((n == 4) & red & made, "CGEMM")
        .when(made, "Map")
        .otherwise("Unknown")
    )
    return features.select("task", label.alias("label"))
