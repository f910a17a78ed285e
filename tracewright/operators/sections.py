"""Nested instances of sections (kernels) along a trace, and the runs outside them.

``members(block, section)`` names the blocks of each section, ``hierarchy(parent, child)`` is a forest of sections.
A section without a parent has an instance for each uninterrupted stay; a section below has one for each instance of
its parent in which it is entered, however often. As a section lies in its ancestors, an instance is thus known by its
thread, the stay of its topmost section, and its name: no pass a level is needed over the trace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import running
from .iterate import settled, small_side


def lineage(members: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """``section, ancestor, distance`` for every section, itself (0) included; one join a level of the hierarchy.

    A section on a cycle of the hierarchy, or with two parents, is an error.
    """
    up = hierarchy.where("parent IS NOT NULL AND child IS NOT NULL").select("parent", "child").distinct()
    if up.groupBy("child").count().where("count > 1").head(1):
        raise ValueError("a section has two parents")
    names = members.select("section").unionByName(up.select(F.explode(F.array("parent", "child")).alias("section"))).where("section IS NOT NULL").distinct()
    level = settled(names.select("section", F.col("section").alias("ancestor"), F.lit(0).alias("distance")))
    found = level
    while True:
        level = settled(level.join(up, F.col("ancestor") == F.col("child")).select("section", F.col("parent").alias("ancestor"), (F.col("distance") + 1).alias("distance")))
        if level.isEmpty():
            return settled(found)
        if level.where("section = ancestor").head(1):
            raise ValueError("the hierarchy has a cycle")
        found = found.unionByName(level)


def _live(trace: DataFrame, members: DataFrame, kin: DataFrame, bucket_seconds: int | None) -> DataFrame:
    """The trace with ``now`` and ``was``: the sections (with their topmost one) of the row's block and of the block before, ancestors included."""
    top = kin.groupBy("section").agg(F.max_by("ancestor", "distance").alias("root"))
    closed = members.select("block", F.col("section").alias("_s")).join(kin.withColumnRenamed("section", "_s"), "_s").select("block", F.col("ancestor").alias("section")).distinct()
    of = closed.join(top, "section").groupBy("block").agg(F.collect_set(F.struct("section", "root")).alias("now"))
    none = F.array().cast(of.schema["now"].dataType)
    # Rows are sorted with their blocks alone, and meet the sections of both afterwards.
    of = small_side(settled(of), 200)
    rows = running.previous(trace.select("thread", "ts", "seq", "block"), "block", "was_block", bucket_seconds=bucket_seconds)
    rows = rows.join(of, "block", "left").join(of.select(F.col("block").alias("was_block"), F.col("now").alias("was")), "was_block", "left")
    return rows.select("thread", "ts", "seq", "block", F.coalesce("now", none).alias("now"), F.coalesce("was", none).alias("was"))


def instance_tree(trace: DataFrame, members: DataFrame, hierarchy: DataFrame, bucket_seconds: int | None = None) -> DataFrame:
    """``thread, section, instance, parent, parent_instance, entries, iterations, steps, ts, seq``.

    ``instance`` counts from 1 within thread and section; ``entries`` how often the section was entered during it;
    ``iterations`` the steps on from inside to a block by which the section is entered anywhere in the trace;
    ``ts, seq`` its first step. Rows without a thread count as a thread of their own; blocks in no section give nothing.
    """
    kin = lineage(members, hierarchy)
    live = _live(trace, members, kin, bucket_seconds)
    by_root = live.select("*", F.explode(F.array_distinct(F.transform("now", lambda x: x["root"]))).alias("root"))
    fresh = ~F.exists("was", lambda x: x["section"] == F.col("root"))
    stays = running.total(by_root, fresh.cast("long"), "stay", keys=("thread", "root"), bucket_seconds=bucket_seconds)
    mine = stays.select("thread", "ts", "seq", "block", "root", "stay", F.explode(F.filter("now", lambda x: x["root"] == F.col("root"))["section"]).alias("section"), "was")
    rows = mine.withColumn("entry", (~F.exists("was", lambda x: x["section"] == F.col("section"))).cast("long"))
    at = F.min(F.struct("ts", "seq")).alias("at")
    # Aggregated once, as both the heads and the instances are read from it.
    of_block = settled(rows.groupBy("thread", "root", "stay", "section", "block").agg(F.count("*").alias("steps"), F.sum("entry").alias("entries"), at))
    heads = of_block.where("entries > 0").select("section", "block").distinct().withColumn("head", F.lit(True))
    turns = F.when(F.col("head"), F.col("steps") - F.col("entries")).otherwise(0)
    whole = of_block.join(heads, ["section", "block"], "left").groupBy("thread", "root", "stay", "section").agg(F.sum("entries").alias("entries"), F.sum(turns).alias("iterations"), F.sum("steps").alias("steps"), F.min("at").alias("at"))
    flat = whole.select("thread", "root", "stay", "section", "entries", "iterations", "steps", "at.ts", "at.seq")
    numbered = settled(running.total(flat, F.lit(1).cast("long"), "instance", keys=("thread", "section"), bucket_seconds=bucket_seconds))
    parents = kin.where("distance = 1").select("section", F.col("ancestor").alias("parent"))
    above = numbered.select(F.col("thread").alias("_t"), F.col("stay").alias("_k"), F.col("section").alias("_s"), F.col("instance").alias("parent_instance"))
    met = F.col("thread").eqNullSafe(F.col("_t")) & (F.col("stay") == F.col("_k")) & (F.col("parent") == F.col("_s"))
    out = numbered.join(parents, "section", "left").join(above, met, "left")
    return out.select("thread", "section", "instance", "parent", "parent_instance", "entries", "iterations", "steps", "ts", "seq")


def hierarchy_documents(tree: DataFrame) -> DataFrame:
    """``thread, section, instance, document``: each topmost instance of ``instance_tree`` with all below it as JSON, in order of their first steps.

    Folds the tree from its leaves, one join a level; a document holds a section once at most.
    """
    nodes = settled(tree)
    depth = nodes.where("parent IS NULL").select("thread", "section", "instance", F.lit(0).alias("depth"))
    found, reached = depth, 0
    while True:
        up = depth.select(F.col("thread").alias("_t"), F.col("section").alias("parent"), F.col("instance").alias("parent_instance"))
        below = nodes.join(up, ["parent", "parent_instance"]).where(F.col("thread").eqNullSafe(F.col("_t")))
        depth = settled(below.select("thread", "section", "instance", F.lit(reached + 1).alias("depth")))
        if depth.isEmpty():
            break
        found, reached = found.unionByName(depth), reached + 1
    placed = settled(found).select(F.col("thread").alias("_t"), "section", "instance", "depth")
    rows = nodes.join(placed, ["section", "instance"]).where(F.col("thread").eqNullSafe(F.col("_t"))).drop("_t")
    folded = None
    for level in range(reached, -1, -1):
        here = rows.where(F.col("depth") == level)
        if folded is None:
            here = here.withColumn("inner", F.lit(""))
        else:
            ordered = F.array_sort(F.collect_list(F.struct("ts", "seq", "section", "text")))
            inner = folded.groupBy(F.col("thread").alias("_t"), F.col("parent").alias("_p"), F.col("parent_instance").alias("_i")).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), ",").alias("inner"))
            here = here.join(inner, F.col("thread").eqNullSafe(F.col("_t")) & (F.col("section") == F.col("_p")) & (F.col("instance") == F.col("_i")), "left").drop("_t", "_p", "_i")
        head = F.to_json(F.struct("section", "instance", "entries", "iterations", "steps"))
        text = F.concat(F.expr("substring(_head, 1, length(_head) - 1)"), F.lit(',"children":['), F.coalesce("inner", F.lit("")), F.lit("]}"))
        folded = here.withColumn("_head", head).withColumn("text", text)
    return folded.select("thread", "section", "instance", F.col("text").alias("document"))


def outside_runs(trace: DataFrame, members: DataFrame, bucket_seconds: int | None = None) -> DataFrame:
    """``blocks, first_block, runs``: the stretches of a thread outside all sections, told apart by their set of blocks and the block they begin with.

    A set holds distinct blocks of the program, however long the stretch. A thread's last stretch counts although no section follows.
    """
    inside = members.select("block").distinct().withColumn("inside", F.lit(1))
    rows = trace.select("thread", "ts", "seq", "block").join(inside, "block", "left")
    numbered = running.total(rows, F.coalesce("inside", F.lit(0)).cast("long"), "run", bucket_seconds=bucket_seconds)
    runs = numbered.where("inside IS NULL AND block IS NOT NULL").groupBy("thread", "run").agg(F.array_sort(F.collect_set("block")).alias("blocks"), F.min_by("block", F.struct("ts", "seq")).alias("first_block"))
    return runs.groupBy("blocks", "first_block").agg(F.count("*").alias("runs"))
