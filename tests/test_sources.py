"""Files: binary profile, JSON documents, dot, annotated source."""

import json
import struct

import pytest

from tracewright.operators import dataflow, epochs, segment
from tracewright.sources import jsonfiles, markov_bin, text


def test_binary_profile_round_trip(spark, tmp_path):
    markov_bin.register(spark)
    rows = [([i], i + 1, 2**33 + i) for i in range(100)]
    df = spark.createDataFrame(rows, "src_state array<long>, snk long, freq long")
    df.repartition(3).write.format("markov_bin").mode("append").save(str(tmp_path / "p"))
    got = spark.read.format("markov_bin").load(str(tmp_path / "p"))
    assert sorted(map(tuple, got.collect())) == rows


def test_binary_layout_of_order_two(spark, tmp_path):
    markov_bin.register(spark)
    (tmp_path / "a.bin").write_bytes(struct.pack("<III", 2, 9, 1) + struct.pack("<IIIQ", 1, 2, 3, 7))
    assert [tuple(r) for r in spark.read.format("markov_bin").load(str(tmp_path / "a.bin")).collect()] == [([1, 2], 3, 7)]
    (tmp_path / "b.bin").write_bytes(struct.pack("<III", 1, 9, 5))
    with pytest.raises(Exception, match="fewer edges"):
        spark.read.format("markov_bin").load(str(tmp_path / "b.bin")).collect()


def test_block_info(spark, tmp_path):
    doc = {"7": {"BlockCallers": [1, 2], "Labels": {"a": 3}}, "8": {"BlockCallers": [7]}, "ThreadLaunchers": [4], "ThreadEntrances": []}
    (tmp_path / "b.json").write_text(json.dumps(doc))
    callers, labels, threads = jsonfiles.read_block_info(spark, str(tmp_path / "b.json"))
    assert sorted(map(tuple, callers.collect())) == [(7, 1), (7, 2), (8, 7)]
    assert [tuple(r) for r in labels.collect()] == [(7, "a", 3)]
    assert [tuple(r) for r in threads.collect()] == [("ThreadLaunchers", 4)]
    back = json.loads(jsonfiles.write_block_info(callers, labels).first().value)
    assert back["7"] == {"BlockCallers": [1, 2], "Labels": {"a": 3}}
    (tmp_path / "n.json").write_text("null")
    assert all(df.count() == 0 for df in jsonfiles.read_block_info(spark, str(tmp_path / "n.json")))


def test_kernels_and_boundaries(spark, tmp_path):
    kernel = lambda blocks, kids, parents: {"Nodes": blocks, "Blocks": blocks, "Children": kids, "Parents": parents, "Labels": [""], "Entrances": {"1": ["2"]}, "Exits": {"3": ["4", "5"]}}
    doc = {"ValidBlocks": [1], "NonKernelBlocks": [], "Kernels": {"0": kernel([2], [], [3]), "3": kernel([2, 3], [0], [])}, "Average Kernel Size (Blocks)": 1.5}
    (tmp_path / "k.json").write_text(json.dumps(doc))
    k = jsonfiles.read_kernels(spark, str(tmp_path / "k.json"))
    assert sorted((r.kernel, r.blocks) for r in k.collect()) == [(0, [2]), (3, [2, 3])]
    assert sorted(map(tuple, epochs.boundaries(k).collect())) == [(1, 2), (3, 4), (3, 5)]
    assert jsonfiles.read_kernel_summary(spark, str(tmp_path / "k.json")).first().avg_blocks == 1.5


def test_hierarchy(spark):
    members = spark.createDataFrame([(0, 2), (1, 5), (3, 2), (3, 3), (4, 2), (4, 3)], "kernel int, block int")
    hierarchy = spark.createDataFrame([(3, 0), (4, 3)], "parent int, child int")
    assert {r.kernel: r.level for r in segment.levels(hierarchy, members).collect()} == {0: 2, 1: 0, 3: 1, 4: 0}
    assert sorted(r.kernel for r in segment.distinct_sets(members).collect()) == [0, 1, 3]
    assert sorted(map(tuple, segment.exclusive(members, hierarchy).collect())) == [(0, 2), (1, 5), (3, 3)]
    assert segment.block_closure(members, hierarchy).count() == 6


def test_dot_and_annotation(spark):
    e = spark.createDataFrame([("a", "b", 0.5)], "src string, snk string, weight double")
    assert [r.line for r in text.dot("g", text.dot_edges(e)).collect()] == ["digraph g {", '"a" -> "b" [label=0.5000];', "}"]
    files = spark.createDataFrame([("f.c", "int a;\n  for (;;)\n    b();")], "path string, content string")
    notes = spark.createDataFrame([("f.c", 2, "#pragma omp parallel for")], "path string, number int, note string")
    assert text.annotate(text.source_lines(files), notes).first().content == "int a;\n  #pragma omp parallel for\n  for (;;)\n    b();"


def test_dataflow(spark):
    insts = spark.createDataFrame([(1, "load"), (2, "fadd"), (3, "phi"), (4, "store"), (5, "br"), (6, "add")], "inst int, op string")
    du = spark.createDataFrame([(1, 2), (3, 2), (2, 3), (2, 4), (6, 5)], "src int, snk int")
    assert {r.id for r in dataflow.function_nodes(insts, du).collect()} == {1, 2, 3, 4}
    assert [tuple(r) for r in dataflow.reductions(insts, du).collect()] == [(3, 2, "fadd")]
    assert dataflow.serial_reductions(dataflow.reductions(insts, du), du).count() == 0
    exits = spark.createDataFrame([(5,)], "inst int")
    colours = dataflow.colours(insts, dataflow.function_nodes(insts, du), dataflow.state_nodes(insts, du, exits), insts.select(insts.inst.alias("id")).where("id < 0"))
    assert {r.inst: r.colour for r in colours.collect()} == {1: "Function", 2: "Function", 3: "Function", 4: "Function", 5: "State", 6: "State"}
    shown = dataflow.expressions(spark.createDataFrame([(1, 2), (2, 4)], "src int, snk int"), insts, spark.createDataFrame([(4,)], "inst int"))
    assert shown.first().text == "store(fadd(v1))"
    t = dataflow.tasks(spark.createDataFrame([(1,), (2,), (3,)], "cycle int"), spark.createDataFrame([(2, 1)], "parent int, child int"))
    assert sorted((r.cycle, r.task) for r in t.collect()) == [(1, 2), (2, 2), (3, 3)]
