"""Inclusive address intervals ``base, end`` under any grouping columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .iterate import spread

#: An epoch side without an interval longer than this is dropped; precedence of access kinds, the highest first.
LONGER_THAN = 32
PRECEDENCE = ("memcpy", "memmove", "memset", "malloc", "free", "reader", "writer")


def accesses(events: DataFrame) -> DataFrame:
    """``epoch, rw, type, base, end, seq`` from ``events(epoch, seq, op, addr, src, size)``.

    Loads and stores span ``addr .. addr + size``, the others ``addr .. addr + size - 1``; copies
    read their source and write their target.
    """
    span = lambda rw, kind, at, less: F.struct(F.lit(rw).alias("rw"), F.lit(kind).alias("type"), F.col(at).alias("base"), (F.col(at) + F.col("size") - less).alias("end"))
    made = (
        F.when(F.col("op") == "load", F.array(span("READ", "reader", "addr", 0)))
        .when(F.col("op") == "store", F.array(span("WRITE", "writer", "addr", 0)))
        .when(F.col("op") == "memcpy", F.array(span("READ", "memcpy", "src", 1), span("WRITE", "memcpy", "addr", 1)))
        .when(F.col("op") == "memmove", F.array(span("READ", "memmove", "src", 1), span("WRITE", "memmove", "addr", 1)))
        .when(F.col("op") == "memset", F.array(span("WRITE", "memset", "addr", 1)))
        .when(F.col("op") == "malloc", F.array(span("ALLOC", "malloc", "addr", 1)))
        .when(F.col("op") == "free", F.array(span("FREE", "free", "addr", 1)))
    )
    return events.select("epoch", "seq", F.explode(made).alias("s")).select("epoch", "seq", "s.*")


def precedence(kind: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, reversed(PRECEDENCE))), kind), F.lit(0))


def _marked(spans: DataFrame, name: str, *by: str) -> DataFrame:
    """``spans`` with the number ``name`` of the union, of spans that share a point, that each lies in. A running maximum of ends marks where a new union starts; no join."""
    w = W.partitionBy(*by).orderBy("base", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(reach.isNull() | (F.col("base") > reach), 1).otherwise(0))
    return marked.withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_new")


def _unions(spans: DataFrame, *by: str) -> DataFrame:
    extra = [F.max_by("type", precedence(F.col("type"))).alias("type")] if "type" in spans.columns and "type" not in by else []
    return _marked(spans, "_island", *by).groupBy(*by, "_island").agg(F.min("base").alias("base"), F.max("end").alias("end"), F.count("*").alias("ref_count"), *extra).drop("_island")


def coalesce(spans: DataFrame, *by: str, partitions: int | None = None) -> DataFrame:
    """``*by, base, end, ref_count``: maximal unions of spans that share a point; ref_count is the number merged into each.

    ``partitions`` (by default from a count of ``spans``) bounds what one task sorts.
    """
    return _unions(spread(spans, *by, n=partitions), *by)


def access_pattern(spans: DataFrame) -> DataFrame:
    """``epoch, pattern``: whether an epoch's first access reads or writes, and what follows."""
    first = F.min_by("rw", F.struct("seq", "rw"))
    later = F.count_distinct("rw") > 1
    name = F.when(first == "READ", F.when(later, "ReadThenWrite").otherwise("Read")).otherwise(F.when(later, "WriteThenRead").otherwise("Write"))
    return spans.where("rw IN ('READ', 'WRITE')").groupBy("epoch").agg(name.alias("pattern"))


def patterned(accesses: DataFrame) -> DataFrame:
    """``epoch, rw, base, end, ref_count, pattern``: coalesced reads and writes, each with the pattern of the union of accesses it lies in.

    Reads and writes of an epoch that share a point, directly or through others, form a union; its first access
    (by ``seq``; a read before a write at the same one) and whether the other kind follows name its pattern.
    """
    marked = _marked(spread(accesses.where("rw IN ('READ', 'WRITE')"), "epoch"), "_union", "epoch")
    union = W.partitionBy("epoch", "_union")
    first, later = F.min_by("rw", F.struct("seq", "rw")).over(union), F.min("rw").over(union) != F.max("rw").over(union)
    name = F.when(first == "READ", F.when(later, "ReadThenWrite").otherwise("Read")).otherwise(F.when(later, "WriteThenRead").otherwise("Write"))
    named = marked.select("epoch", "_union", "rw", "base", "end", name.alias("pattern"))
    return _unions(named, "epoch", "_union", "pattern", "rw").select("epoch", "rw", "base", "end", "ref_count", "pattern")


def _binned(spans: DataFrame, width: int) -> DataFrame:
    return spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("base") / width), F.floor(F.col("end") / width))))


def overlaps(left: DataFrame, right: DataFrame, *by: str, width: int = 256) -> DataFrame:
    """Pairs that share a point: left columns, right ones with prefix ``r_``, and the shared ``lo, hi``.

    An equi-join on the bins that spans touch; a pair counts in the bin where the shared part begins.
    """
    other = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    other = other.withColumn("_rbin", F.explode(F.sequence(F.floor(F.col("r_base") / width), F.floor(F.col("r_end") / width))))
    lo, hi = F.greatest("base", "r_base"), F.least("end", "r_end")
    cond = (F.col("_bin") == F.col("_rbin")) & (lo <= hi) & (F.floor(lo / width) == F.col("_bin"))
    for c in by:
        cond = cond & (F.col(c) == F.col(f"r_{c}"))
    return _binned(left, width).join(other, cond).withColumns({"lo": lo, "hi": hi}).drop("_bin", "_rbin")


def subtract(left: DataFrame, right: DataFrame, *by: str, partitions: int | None = None) -> DataFrame:
    """``*by, base, end``: the points of ``left`` that no span of ``right`` holds, as maximal spans. A sweep over end points: one window, no join.

    ``partitions`` (by default from a count of the end points) bounds what one task sorts.
    """
    ends = lambda df, side: df.select(*by, F.explode(F.array(F.struct(F.col("base").alias("p"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("p"), F.lit(-1).alias("d")))).alias("x"), F.lit(side).alias("side")).select(*by, "x.p", F.when(F.col("side") == 0, F.col("x.d")).otherwise(0).alias("a"), F.when(F.col("side") == 1, F.col("x.d")).otherwise(0).alias("b"))
    steps = spread(ends(left, 0).unionByName(ends(right, 1)), *by, n=partitions).groupBy(*by, "p").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = W.partitionBy(*by).orderBy("p")
    run = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = steps.select(*by, F.col("p").alias("base"), (F.lead("p").over(w) - 1).alias("end"), F.sum("a").over(run).alias("a"), F.sum("b").over(run).alias("b")).where("a > 0 AND b = 0")
    return merge_adjacent(parts, *by)


def merge_adjacent(spans: DataFrame, *by: str) -> DataFrame:
    """Disjoint spans with those that follow each other without a gap joined."""
    w = W.partitionBy(*by).orderBy("base")
    fresh = F.coalesce(F.lag("end").over(w) + 1 < F.col("base"), F.lit(True)).cast("int")
    marked = spans.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return marked.groupBy(*by, "_island").agg(F.min("base").alias("base"), F.max("end").alias("end")).drop("_island")


def long_sides(spans: DataFrame, longer_than: int = LONGER_THAN) -> DataFrame:
    """Spans of the (epoch, rw) sides that have one longer than ``longer_than``."""
    long_ = spans.groupBy("epoch", "rw").agg(F.max(F.col("end") - F.col("base")).alias("longest")).where(F.col("longest") > longer_than)
    return spans.join(long_.select("epoch", "rw"), ["epoch", "rw"], "left_semi")


def without_temporaries(spans: DataFrame) -> DataFrame:
    """Reads and writes less what was allocated and freed in the same epoch."""
    freed = spans.where("rw = 'FREE'").select("epoch", "base").distinct()
    temporary = spans.where("rw = 'ALLOC'").join(freed, ["epoch", "base"], "left_semi")
    sides = temporary.select("epoch", "base", "end", F.explode(F.array(F.lit("READ"), F.lit("WRITE"))).alias("rw"))
    return subtract(spans.where("rw IN ('READ', 'WRITE')"), sides, "epoch", "rw")


def footprint(spans: DataFrame, *by: str) -> DataFrame:
    """Addresses held by coalesced spans."""
    return spans.groupBy(*by).agg(F.sum(F.col("end") - F.col("base") + 1).alias("bytes"))
