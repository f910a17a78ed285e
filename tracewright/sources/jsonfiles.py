"""JSON documents with dynamic keys: block information, kernels, instances, loops; and their writers.

The documents are read whole (they describe one program) and taken apart by ``from_json`` into maps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "map<string, struct<BlockCallers: array<bigint>, Labels: map<string, bigint>>>"
KERNEL = "struct<Nodes: array<bigint>, Blocks: array<bigint>, Children: array<bigint>, Parents: array<bigint>, Dominators: array<bigint>, Labels: array<string>, Entrances: map<string, array<string>>, Exits: map<string, array<string>>>"
MEASURE = "struct<`Entropy Rate`: double, `Total Entropy`: double, Nodes: bigint, Edges: bigint>"
KERNEL_FILE = f"struct<ValidBlocks: array<bigint>, NonKernelBlocks: array<bigint>, BlockCallers: map<string, array<bigint>>, Entropy: struct<Start: {MEASURE}, `End`: {MEASURE}>, `Average Kernel Size (Nodes)`: double, `Average Kernel Size (Blocks)`: double, Kernels: map<string, {KERNEL}>, `Instruction Tuples`: array<bigint>>"
LOOP_FILE = "struct<Loops: array<struct<Blocks: array<bigint>, Type: array<int>, IV: array<bigint>, BasePointers: array<bigint>, Functions: array<bigint>>>, `Static Blocks`: array<bigint>>"


def _by_key(pairs):
    """A map from a list of (k, v) pairs, in the order of keys."""
    order = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    return F.map_from_entries(F.array_sort(pairs, order))


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path)


def read_block_info(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``callers(block, callee)``, ``labels(block, label, votes)`` and ``threads(role, block)``; the document ``null`` gives empty tables.

    The keys of threads hold arrays, the others objects: the document is read as a map of raw values first.
    """
    raw = _whole(spark, path).select(F.explode(F.from_json("value", "map<string, string>")).alias("key", "raw"))
    is_thread = F.col("key").isin("ThreadLaunchers", "ThreadEntrances")
    block = raw.where(~is_thread).select(F.col("key").cast("bigint").alias("block"), F.from_json("raw", "struct<BlockCallers: array<bigint>, Labels: map<string, bigint>>").alias("b"))
    callers = block.select("block", F.explode("b.BlockCallers").alias("callee"))
    labels = block.select("block", F.explode("b.Labels").alias("label", "votes"))
    threads = raw.where(is_thread).select(F.col("key").alias("role"), F.explode(F.from_json("raw", "array<bigint>")).alias("block"))
    return callers, labels, threads


def write_block_info(callers: DataFrame, labels: DataFrame) -> DataFrame:
    """One row ``value``: the JSON document of callers and labels by block."""
    c = callers.groupBy("block").agg(F.array_sort(F.collect_set("callee")).alias("BlockCallers"))
    v = labels.groupBy("block").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "votes")))).alias("Labels"))
    both = c.join(v, "block", "full").select(F.col("block").cast("string").alias("k"), F.struct("BlockCallers", "Labels").alias("v"))
    return both.agg(F.to_json(_by_key(F.collect_list(F.struct("k", "v")))).alias("value"))


def read_kernels(spark: SparkSession, path: str) -> DataFrame:
    """One row a kernel: ``kernel, nodes, blocks, children, parents, labels, entrances, exits`` (ends are block -> blocks)."""
    doc = _whole(spark, path).select(F.from_json("value", KERNEL_FILE).alias("d"))
    k = doc.select(F.explode("d.Kernels").alias("kernel", "k"))
    ends = lambda c: F.transform_values(F.transform_keys(F.coalesce(c, F.create_map().cast("map<string,array<string>>")), lambda a, _: a.cast("bigint")), lambda _, b: F.transform(b, lambda x: x.cast("bigint")))
    return k.select(F.col("kernel").cast("bigint").alias("kernel"), F.col("k.Nodes").alias("nodes"), F.col("k.Blocks").alias("blocks"), F.col("k.Children").alias("children"), F.col("k.Parents").alias("parents"), F.col("k.Labels").alias("labels"), ends(F.col("k.Entrances")).alias("entrances"), ends(F.col("k.Exits")).alias("exits"))


def read_kernel_summary(spark: SparkSession, path: str) -> DataFrame:
    """The document's other keys, one row."""
    doc = _whole(spark, path).select(F.from_json("value", KERNEL_FILE).alias("d"))
    return doc.select("d.ValidBlocks", "d.NonKernelBlocks", "d.Entropy", F.col("d.Average Kernel Size (Nodes)").alias("avg_nodes"), F.col("d.Average Kernel Size (Blocks)").alias("avg_blocks"), F.col("d.Instruction Tuples").alias("instructions"))


def read_loops(spark: SparkSession, path: str) -> DataFrame:
    """``loop, block`` of static loops, numbered in file order."""
    doc = _whole(spark, path).select(F.from_json("value", LOOP_FILE).alias("d"))
    return doc.select(F.posexplode("d.Loops").alias("loop", "l")).select("loop", F.explode("l.Blocks").alias("block"))


def write_kernels(kernels: DataFrame, valid: DataFrame, outside: DataFrame) -> DataFrame:
    """One row ``value``: the kernel document; ``kernels`` as ``segment.table`` gives them."""
    own = kernels.select(F.col("kernel").cast("string").alias("k"), F.struct(F.col("blocks").alias("Blocks"), F.col("children").alias("Children"), F.col("parents").alias("Parents"), F.col("entrances").alias("Entrances"), F.col("exits").alias("Exits")).alias("v"))
    every = own.agg(_by_key(F.collect_list(F.struct("k", "v"))).alias("Kernels"), F.lit(0).alias("j"))
    size = kernels.agg(F.coalesce(F.avg(F.size("blocks")), F.lit(0.0)).alias("Average Kernel Size (Blocks)"), F.lit(0).alias("j"))
    lists = valid.agg(F.array_sort(F.collect_set("block")).alias("ValidBlocks"), F.lit(0).alias("j")).join(outside.agg(F.array_sort(F.collect_set("block")).alias("NonKernelBlocks"), F.lit(0).alias("j")), "j")
    return every.join(size, "j").join(lists, "j").select(F.to_json(F.struct("ValidBlocks", "NonKernelBlocks", "Average Kernel Size (Blocks)", "Kernels")).alias("value"))


def hot_instances(kernels: DataFrame, hot: DataFrame) -> DataFrame:
    """Kernels with a hot epoch."""
    return kernels.join(hot.select("kernel").distinct(), "kernel", "left_semi")


def call_graph_json(calls: DataFrame) -> DataFrame:
    """One row ``value``: caller -> [callee]."""
    per = calls.groupBy("caller").agg(F.array_sort(F.collect_set("callee")).alias("callees"))
    return per.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("caller", "callees"))))).alias("value"))
