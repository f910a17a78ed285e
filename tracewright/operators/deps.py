"""Which epoch's data an epoch uses: last-writer dependencies over coalesced spans ``epoch, rw, base, end``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import LONGER_THAN, subtract
from .iterate import checkpoint, partitions, settled, spread


#: Consumers, writers and what they share, as ``explain`` gives them.
PARTS = "epoch long, upto long, own long, since long, first long, last long, writer long, w_base long, both boolean, _bin long, lo long, hi long"


def binned(spans: DataFrame, width: int) -> DataFrame:
    """A row for each bin of ``width`` that a span touches, with the part inside as ``lo, hi``."""
    cut = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("base") / width), F.floor(F.col("end") / width))))
    return cut.withColumns({"lo": F.greatest(F.col("base"), F.col("_bin") * width), "hi": F.least(F.col("end"), F.col("_bin") * width + (width - 1))})


def explain(writes: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """The parts of ``asked(epoch, upto, own, since, base, end)`` that the newest of ``writes(epoch, base, end, both)`` up to ``upto`` wrote, cut at bins.

    A bin is swept in order of epochs: a write is put over what its addresses held, a consumer reads what they hold as stretches of one writer
    span each. A task holds one bin's addresses, however many epochs touch it, and a stretch is one row, however many end points lie in it.
    """
    none = lambda kind: F.lit(None).cast(kind)
    # Odd positions in time are consumers, just after the epoch they look back from.
    own = binned(writes, width).select("_bin", (F.col("epoch") * 2).alias("_at"), "lo", "hi", F.col("base").alias("mark"), none("long").alias("epoch"), none("long").alias("since"), "both", none("long").alias("first"), none("long").alias("last"))
    want = binned(asked, width).select("_bin", (F.col("upto") * 2 + 1).alias("_at"), "lo", "hi", F.col("own").alias("mark"), "epoch", "since", none("boolean").alias("both"), F.col("base").alias("first"), F.col("end").alias("last"))

    def sweep(batches):
        from itertools import groupby

        import pyarrow as pa

        place, held = None, None
        for batch in batches:
            found = []
            for at_bin, at, lo, hi, mark, epoch, since, both, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                if at_bin != place:
                    place, held = at_bin, [None] * width
                begin = at_bin * width
                if at % 2 == 0:
                    held[lo - begin : hi - begin + 1] = [(at // 2, mark, both)] * (hi - lo + 1)
                    continue
                for writer, run in groupby(held[lo - begin : hi - begin + 1]):
                    n = len(list(run))
                    if writer is not None:
                        found.append((epoch, at // 2, mark, since, first, last, *writer, at_bin, lo, lo + n - 1))
                    lo += n
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if name == "both" else pa.int64()) for name, c in zip(names, zip(*found))], names=names)

    names = [f.split()[0] for f in PARTS.split(", ")]
    # Spans of one epoch that share an address: the greatest base stands.
    rows = spread(own.unionByName(want), "_bin").sortWithinPartitions("_bin", "_at", "mark")
    return rows.mapInArrow(sweep, PARTS)


def edges(parts: DataFrame, longer_than: int, width: int) -> DataFrame:
    """``epoch, writer, hops`` (the least) of the stretches longer than ``longer_than`` of one producer span within one consumer, from ``explain``'s parts with ``hops``.

    Only what ends at a bin's or (behind a copy) a wanted part's border can go on elsewhere: other short stretches go at once.
    """
    key = ("epoch", "upto", "own", "writer", "w_base")
    open_ = (F.col("lo") % width == 0) | ((F.col("hi") + 1) % width == 0) | (F.col("own").isNull() & ((F.col("lo") == F.col("first")) | (F.col("hi") == F.col("last"))))
    length = F.col("hi") - F.col("lo")
    kept = parts.where((length > longer_than) | open_).select(*key, "lo", "hi", "hops")
    w = W.partitionBy(*key).orderBy("lo")
    reach = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.coalesce(reach + 1 < F.col("lo"), F.lit(True)).cast("int")
    runs = kept.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    whole = runs.groupBy(*key, "_run").agg((F.max("hi") - F.min("lo")).alias("length"), F.min("hops").alias("hops"))
    return whole.where(F.col("length") > longer_than).groupBy("epoch", "writer").agg(F.min("hops").alias("hops"))


def dependencies(spans: DataFrame, consumer: str = "READ", longer_than: int = LONGER_THAN, width: int = 256, patterns: DataFrame | None = None) -> DataFrame:
    """``epoch, writer``: epochs that use (READ) or overwrite (WRITE) what ``writer`` was the last to write before them.

    A part of a consumer's span belongs to the greatest earlier epoch that wrote it. An edge
    needs a stretch of parts of one consumer span and one producer span longer than
    ``longer_than``. ``patterns(epoch, pattern)`` leaves out pairs that both write before they read.
    """
    spans = checkpoint(_whole_numbers(spans))
    writes = spans.where("rw = 'WRITE'").select("epoch", "base", "end", F.lit(False).alias("both"))
    used = explain(writes, _asked(spans.where(F.col("rw") == consumer), F.lit(None)), width)
    if patterns is not None:
        both = patterns.where("pattern = 'WriteThenRead'").select("epoch").distinct()
        used = used.join(both.withColumn("_c", F.lit(True)), "epoch", "left").join(both.select(F.col("epoch").alias("writer"), F.lit(True).alias("_p")), "writer", "left").where("_c IS NULL OR _p IS NULL")
    return edges(used.withColumn("hops", F.lit(0).cast("long")), longer_than, width).select("epoch", "writer")


def _whole_numbers(spans: DataFrame, *more) -> DataFrame:
    """``spans`` with whole numbers and without nulls."""
    return spans.where("epoch IS NOT NULL AND base IS NOT NULL AND end IS NOT NULL").select(F.col("epoch").cast("long"), "rw", F.col("base").cast("long"), F.col("end").cast("long"), *more)


def _asked(spans: DataFrame, since: Column) -> DataFrame:
    """Each span as wanted from the epochs before its own."""
    return spans.select("epoch", (F.col("epoch") - 1).alias("upto"), F.col("base").alias("own"), since.cast("long").alias("since"), "base", "end")


def with_copies(spans: DataFrame, copies: DataFrame, longer_than: int = LONGER_THAN) -> DataFrame:
    """``spans`` where an epoch that reads a copy's target also reads its source: ``copies(epoch, src, dst, size)`` of earlier epochs."""
    return spans.select("epoch", "rw", "base", "end").unionByName(inherited(spans, copies, longer_than))


def inherited(spans: DataFrame, copies: DataFrame, longer_than: int = LONGER_THAN) -> DataFrame:
    """``epoch, rw, base, end``: what reads take over from copies of earlier epochs.

    A shared part longer than ``longer_than`` holds a multiple of ``longer_than + 1``: spans that are long enough meet at these points, once each, at the first.
    """
    step = max(longer_than, 0) + 1
    c_end = F.col("dst") + F.col("size") - 1
    points = lambda a, b: F.explode(F.sequence(F.ceil(a / step), F.floor(b / step)))
    holds = lambda a, b: F.ceil(a / step) <= F.floor(b / step)
    base, end, dst = F.col("base"), F.col("end"), F.col("dst")
    left = spans.where("rw = 'READ'").where((end - base > longer_than) & holds(base, end)).select("epoch", "rw", "base", "end", points(base, end).alias("_at"))
    right = copies.where((c_end - dst > longer_than) & holds(dst, c_end)).select(F.col("epoch").alias("c_epoch"), "src", "dst", c_end.alias("dst_end"), points(dst, c_end).alias("_point"))
    lo, hi = F.greatest("base", "dst"), F.least("end", "dst_end")
    met = left.join(right, (F.col("_at") == F.col("_point")) & (F.col("c_epoch") < F.col("epoch")) & (hi - lo > longer_than) & (F.ceil(lo / step) == F.col("_at")))
    shift = F.col("src") - F.col("dst")
    return met.select("epoch", "rw", (lo + shift).alias("base"), (hi + shift).alias("end")).distinct()


def copy_targets(spans: DataFrame, longer_than: int = LONGER_THAN) -> DataFrame:
    """``epoch, dst, dst_end, src, src_end`` of copies whose source the trace doesn't name: ``spans(epoch, rw, type, base, end)``.

    A memcpy copies the epoch's first read that shares more than ``longer_than`` with its target, a memmove the first
    read at least as long as its target (first by base and end). Copies without such a read are left out.
    """
    reads = spans.where("rw = 'READ'").select("epoch", F.col("base").alias("src"), F.col("end").alias("src_end")).distinct()
    made = spans.where("rw = 'WRITE' AND type IN ('memcpy', 'memmove')").select("epoch", "type", F.col("base").alias("dst"), F.col("end").alias("dst_end")).distinct()
    shared = F.least("src_end", "dst_end") - F.greatest("src", "dst") > longer_than
    as_long = F.col("src_end") - F.col("src") >= F.col("dst_end") - F.col("dst")
    met = made.join(reads, "epoch").where(F.when(F.col("type") == "memcpy", shared).otherwise(as_long))
    first = met.groupBy("epoch", "type", "dst", "dst_end").agg(F.min(F.struct("src", "src_end")).alias("s"))
    return first.select("epoch", "dst", "dst_end", "s.src", "s.src_end").distinct()


def _latest(parts: DataFrame, value: Column, bucket: int) -> DataFrame:
    """``parts`` with ``w``: the greatest ``value`` of the same place (``_bin, lo``) at an earlier ``_at``.

    A place that very many epochs touch is split into ``bucket`` steps of ``_at``; what came before a bucket reaches it as one value.
    """
    cut = parts.withColumn("_b", F.floor(F.col("_at") / bucket))
    inside = W.partitionBy("_bin", "lo", "_b").orderBy("_at").rangeBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("_bin", "lo").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = cut.groupBy("_bin", "lo", "_b").agg(F.max(value).alias("_m")).withColumn("_c", F.max("_m").over(before)).where("_c IS NOT NULL").drop("_m")
    return cut.withColumn("_i", F.max(value).over(inside)).join(carried, ["_bin", "lo", "_b"], "left").withColumn("w", F.coalesce("_i", "_c")).drop("_b", "_i", "_c")


def _since(writes: DataFrame, consumers: DataFrame, bucket: int) -> DataFrame:
    """``consumers`` with ``since``: the newest earlier epoch that has a WriteThenRead span among its writes, for consumers of that pattern."""
    same = "pattern = 'WriteThenRead'"
    ids = consumers.where(same).select("epoch", F.lit(None).cast("long").alias("e")).unionByName(writes.where(same).select("epoch", F.col("epoch").alias("e"))).distinct()
    at = ids.select(F.lit(0).alias("_bin"), F.lit(0).alias("lo"), F.col("epoch").alias("_at"), "epoch", "e")
    found = _latest(at, F.col("e"), bucket).groupBy("epoch").agg(F.max("w").alias("since"))
    return consumers.join(found, "epoch", "left").withColumn("since", F.when(F.expr(same), F.col("since")))


def sources(spans: DataFrame, copies: DataFrame | None = None, consumer: str = "READ", longer_than: int = LONGER_THAN, width: int = 256, bucket: int = 4096) -> DataFrame:
    """``epoch, writer, hops``: whose data an epoch uses (READ) or overwrites (WRITE), through any number of copies.

    ``spans(epoch, rw, base, end[, pattern])`` are disjoint in each epoch and side. Each consumed span starts as wanted
    from the epochs before its own. The newest writer explains each wanted part, which leaves the rest;
    a part explained by a copy ``copies(epoch, dst, dst_end, src, src_end)`` is wanted again at the copy's source, from the copy's
    epoch backwards, less what was wanted so already: thus copies in a circle end. A source as long as its target
    passes on the part asked for, any other the whole of itself. An overwritten span
    is only traced to its last writer.

    An edge needs a stretch longer than ``longer_than`` that one producer span explains of one consumed span (or, behind a
    copy, of all that was wanted from there); shorter ones explain without an edge. ``hops`` is the least number of copies between.
    With ``pattern``, a consumed WriteThenRead span drops out without an edge at the newest earlier epoch with a
    WriteThenRead write: of that epoch other writes still count, of older ones none. What is passed on carries no pattern.
    Null epochs or bounds drop out; empty tables give none.
    """
    known = "pattern" in spans.columns
    pattern = F.col("pattern") if known else F.lit(None).cast("string").alias("pattern")
    spans = checkpoint(_whole_numbers(spans, pattern))
    writes = spans.where("rw = 'WRITE'").drop("rw")
    wanted = spans.where(F.col("rw") == consumer).drop("rw")
    asked = _asked(_since(writes, wanted, bucket), F.col("since")) if known else _asked(wanted, F.lit(None))
    chained = copies is not None and consumer == "READ"
    if chained:
        copies = copies.select(F.col("epoch").cast("long").alias("writer"), *(F.col(c).cast("long") for c in ("dst", "dst_end", "src", "src_end"))).dropna().distinct()
        copies = checkpoint(copies.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("dst") / width), F.floor(F.col("dst_end") / width)))))
        # What a copy's epoch had from before is the same for all that ask there: copies' sources are explained once, with no asker.
        read = copies.select(F.col("writer").alias("upto"), F.col("src").alias("base"), F.col("src_end").alias("end")).distinct()
        none = F.lit(None).cast("long")
        n = partitions(spans)
        read = subtract(read, read.limit(0), "upto", partitions=n).select(none.alias("epoch"), "upto", none.alias("own"), none.alias("since"), "base", "end")
        asked = asked.unionByName(read)
    both = F.coalesce(F.col("pattern") == "WriteThenRead", F.lit(False)).alias("both")
    parts = explain(writes.select("epoch", "base", "end", both), asked, width)
    used = parts.where("since IS NULL OR writer > since OR (writer = since AND NOT both)").drop("since", "both")
    if not chained:
        return edges(used.withColumn("hops", F.lit(0).cast("long")), longer_than, width)
    used = settled(used)
    before = used.where("epoch IS NULL").select("upto", "_bin", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "writer", "w_base")
    used = used.where("epoch IS NOT NULL")
    seen, explained, hop = None, None, 0
    while True:
        part = used.withColumn("hops", F.lit(hop).cast("long"))
        explained = part if explained is None else explained.unionByName(part)
        met = used.join(copies, ["writer", "_bin"]).where("lo <= dst_end AND hi >= dst")
        shift = F.when(F.col("src_end") - F.col("src") == F.col("dst_end") - F.col("dst"), F.col("src") - F.col("dst"))
        passed = met.select("epoch", F.col("writer").alias("upto"), F.coalesce(F.greatest("lo", "dst") + shift, "src").alias("base"), F.coalesce(F.least("hi", "dst_end") + shift, "src_end").alias("end")).distinct()
        # Without a table of what was wanted the subtraction only merges what overlaps or adjoins.
        added = settled(subtract(passed, passed.limit(0) if seen is None else seen, "epoch", "upto", partitions=n))
        if added.isEmpty():
            break
        seen = added if seen is None else seen.unionByName(added)
        near = binned(added.withColumns({"first": F.col("base"), "last": F.col("end")}), width).join(before, ["upto", "_bin"]).where("lo <= _hi AND hi >= _lo")
        used = settled(near.select("epoch", "upto", F.lit(None).cast("long").alias("own"), "first", "last", "writer", "w_base", "_bin", F.greatest("lo", "_lo").alias("lo"), F.least("hi", "_hi").alias("hi")))
        hop += 1
    return edges(explained, longer_than, width)


def sequential(epochs: DataFrame) -> DataFrame:
    """``epoch, next_epoch`` over the totally ordered epoch ids; a range-partitioned sort feeds one small window a partition.

    Epochs are few against events; the one-partition window runs over distinct ids only.
    """
    own = epochs.select("epoch").distinct()
    return own.withColumn("next_epoch", F.lead("epoch").over(W.partitionBy(F.lit(0)).orderBy("epoch"))).where("next_epoch IS NOT NULL")
