"""Command line: ``python -m tracewright COMMAND ...``; run under ``spark-submit`` on a cluster."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import counts, graph, hotcode, local_segment, metrics, rewrite, segment
from tracewright.sources import jsonfiles, markov_bin, text


def profile(spark: SparkSession, path: str) -> DataFrame:
    """Weighted edges of a first-order binary profile."""
    markov_bin.register(spark)
    rows = spark.read.format("markov_bin").load(path)
    return graph.typed(rows.select(F.element_at("src_state", -1).cast("string").alias("src"), F.col("snk").cast("string").alias("snk"), "freq"))


def kernels(spark: SparkSession, a: argparse.Namespace) -> None:
    """Kernels of a profile, or its hot regions with --hot, as JSON; the graph as dot."""
    edges = profile(spark, a.input)
    blocks = counts.block_frequency(edges)
    if a.hot:
        hot = hotcode.hot_blocks(blocks, a.share)
        regions = hotcode.hot_regions(hot, edges)
        if a.loops:
            loops = jsonfiles.read_loops(spark, a.loops).withColumn("block", F.col("block").cast("string"))
            found = hotcode.hot_loops(regions, loops).select(F.col("loop").cast("string").alias("kernel"), "blocks")
        else:
            found = regions.groupBy("region").agg(F.array_sort(F.collect_set("block")).alias("blocks")).select(F.col("region").alias("kernel"), "blocks")
        none = F.array().cast("array<string>")
        found = found.select("kernel", "blocks", none.alias("children"), none.alias("parents"), none.alias("entrances"), none.alias("exits"))
    else:
        found = local_segment.table(spark, local_segment.kernels(rewrite.LocalGraph.of(edges)))
    outside = segment.outside(blocks, found.select("kernel", F.explode("blocks").alias("block")))
    jsonfiles.write_kernels(found, blocks, outside).coalesce(1).write.mode("overwrite").text(a.output)
    if a.dot:
        text.dot("profile", text.dot_edges(edges, text.kind_style(F.col("kind")))).coalesce(1).write.mode("overwrite").text(a.dot)
    if a.verbose:
        metrics.graph_size(edges).show()
        metrics.total_entropy(edges).show()


def callgraph(spark: SparkSession, a: argparse.Namespace) -> None:
    """Callers and callees of a block information document, as JSON."""
    callers, _, _ = jsonfiles.read_block_info(spark, a.input)
    jsonfiles.call_graph_json(callers.select(F.col("block").cast("string").alias("caller"), "callee")).coalesce(1).write.mode("overwrite").text(a.output)


def coverage(spark: SparkSession, a: argparse.Namespace) -> None:
    """Static edges (CSV ``src,snk``) with a flag for those a profile saw."""
    static = spark.read.option("header", True).csv(a.static)
    graph.coverage(static, profile(spark, a.input)).write.mode("overwrite").option("header", True).csv(a.output)


def query(spark: SparkSession, a: argparse.Namespace) -> None:
    """A registered query over a folder of tables, as Parquet."""
    from tracewright.registry import QUERIES

    QUERIES[a.name](spark, a.input).write.mode("overwrite").parquet(a.output)


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="tracewright", description=__doc__)
    commands = top.add_subparsers(required=True)
    for run in (kernels, callgraph, coverage, query):
        p = commands.add_parser(run.__name__, help=run.__doc__)
        p.add_argument("-i", "--input", required=True)
        p.add_argument("-o", "--output", required=True)
        p.set_defaults(run=run)
        if run is kernels:
            p.add_argument("--hot", action="store_true")
            p.add_argument("--share", type=float, default=hotcode.SHARE)
            p.add_argument("--loops")
            p.add_argument("--dot")
            p.add_argument("--verbose", action="store_true")
        if run is coverage:
            p.add_argument("--static", required=True)
        if run is query:
            p.add_argument("name")
    a = top.parse_args(argv)
    a.run(SparkSession.builder.appName("tracewright").getOrCreate(), a)


if __name__ == "__main__":
    main()
