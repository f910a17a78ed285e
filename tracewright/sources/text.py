"""Text outputs: dot graphs, CSV tables, annotated source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators import deps


def dot_edges(edges: DataFrame, style: Column | None = None) -> DataFrame:
    """``line``: one dot statement an edge, labelled with its weight to four digits; kinds have styles."""
    look = style if style is not None else F.lit("")
    label = F.format_string("%.4f", F.round("weight", 4))
    return edges.select(F.concat(F.lit('"'), F.col("src").cast("string"), F.lit('" -> "'), F.col("snk").cast("string"), F.lit('" [label='), label, look, F.lit("];")).alias("line"))


def dot_nodes(nodes: DataFrame, colour: Column | None = None) -> DataFrame:
    fill = F.concat(F.lit(" [style=filled, fillcolor="), colour, F.lit("]")) if colour is not None else F.lit("")
    return nodes.select(F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('"'), fill, F.lit(";")).alias("line"))


def kind_style(kind: Column) -> Column:
    return F.when(kind == "call", ", style=dashed").when(kind == "return", ", style=dotted").when(kind == "imaginary", ", color=gray").otherwise("")


def dot(name: str, *lines: DataFrame) -> DataFrame:
    """``line`` in order: the whole file, ready for ``coalesce(1).write.text``."""
    spark = lines[0].sparkSession
    out = spark.createDataFrame([(0, f"digraph {name} {{")], "part int, line string")
    for k, part in enumerate(lines):
        out = out.unionByName(part.select(F.lit(k + 1).alias("part"), "line"))
    out = out.unionByName(spark.createDataFrame([(len(lines) + 1, "}")], "part int, line string"))
    return out.orderBy("part", "line").select("line")


def epoch_dot(epochs: DataFrame, raw: DataFrame | None = None, waw: DataFrame | None = None) -> DataFrame:
    """``line``: edges between successive epochs, and read-after-write and write-after-write edges if given."""
    line = lambda df, a, b, label: df.select(F.concat(F.col(a).cast("string"), F.lit(" -> "), F.col(b).cast("string"), F.lit(label)).alias("line"))
    out = line(deps.sequential(epochs), "epoch", "next_epoch", " [style=dashed];")
    if raw is not None:
        out = out.unionByName(line(raw, "writer", "epoch", " [label=RAW];"))
    if waw is not None:
        out = out.unionByName(line(waw, "writer", "epoch", " [label=WAW];"))
    return out


def memory_regions(spans: DataFrame) -> DataFrame:
    """``Hierarchy, Type, Start, End`` of coalesced spans, for CSV."""
    return spans.select(F.col("epoch").alias("Hierarchy"), F.col("rw").alias("Type"), F.col("base").alias("Start"), F.col("end").alias("End"))


def source_lines(files: DataFrame) -> DataFrame:
    """``path, number, line`` of ``files(path, content)``."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("number", "line")).withColumn("number", F.col("number") + 1)


def source_map(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """``block, path, number, line``: the source of each block of ``blocks(block, path, number)``."""
    return blocks.join(lines, ["path", "number"])


def annotate(lines: DataFrame, notes: DataFrame) -> DataFrame:
    """``path, content`` of source with ``notes(path, number, note)`` on lines of their own before the line they are about."""
    indent = lines.select("path", "number", F.regexp_extract("line", r"^\s*", 0).alias("indent"))
    extra = notes.join(indent, ["path", "number"]).select("path", "number", F.lit(0).alias("after"), F.concat("indent", "note").alias("line"))
    every = lines.select("path", "number", F.lit(1).alias("after"), "line").unionByName(extra)
    ordered = F.array_sort(F.collect_list(F.struct("number", "after", "line")))
    return every.groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("content"))


def statistics(insts: DataFrame, freqs: DataFrame, kernel_blocks: DataFrame) -> DataFrame:
    """``static, dynamic, in_kernels``: instructions in the program, in observed blocks, in kernels."""
    rows = insts.join(freqs.select("block", F.lit(True).alias("_seen")), "block", "left").join(kernel_blocks.select("block", F.lit(True).alias("_k")).distinct(), "block", "left")
    return rows.agg(F.count("*").alias("static"), F.count_if(F.col("_seen")).alias("dynamic"), F.count_if(F.col("_k")).alias("in_kernels"))


def opcode_histogram(insts: DataFrame) -> DataFrame:
    return insts.groupBy("op").agg(F.count("*").alias("n"))
