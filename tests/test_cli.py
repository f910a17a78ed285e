"""Commands end to end on a small profile."""

import json
import struct

from tracewright.__main__ import main

EDGES = [(0, 1, 1), (1, 2, 1000), (2, 3, 1000), (3, 1, 999), (3, 4, 1), (4, 5, 1)]


def test_commands(spark, tmp_path):
    (tmp_path / "p.bin").write_bytes(struct.pack("<III", 1, 6, len(EDGES)) + b"".join(struct.pack("<IIQ", *e) for e in EDGES))
    main(["kernels", "-i", str(tmp_path / "p.bin"), "-o", str(tmp_path / "k"), "--dot", str(tmp_path / "d")])
    doc = json.loads(spark.read.text(str(tmp_path / "k")).first().value)
    assert [sorted(k["Blocks"]) for k in doc["Kernels"].values()] == [["1", "2", "3"]]
    assert doc["NonKernelBlocks"] == ["4", "5"]
    assert spark.read.text(str(tmp_path / "d")).count() == len(EDGES) + 2
    main(["kernels", "--hot", "-i", str(tmp_path / "p.bin"), "-o", str(tmp_path / "h")])
    hot = json.loads(spark.read.text(str(tmp_path / "h")).first().value)
    assert [k["Blocks"] for k in hot["Kernels"].values()] == [["1", "2", "3"]]
    (tmp_path / "b.json").write_text(json.dumps({"7": {"BlockCallers": [2, 1]}}))
    main(["callgraph", "-i", str(tmp_path / "b.json"), "-o", str(tmp_path / "c")])
    assert json.loads(spark.read.text(str(tmp_path / "c")).first().value) == {"7": [1, 2]}
    (tmp_path / "s.csv").write_text("src,snk\n0,1\n9,1\n")
    main(["coverage", "-i", str(tmp_path / "p.bin"), "--static", str(tmp_path / "s.csv"), "-o", str(tmp_path / "v")])
    assert {(r.src, r.is_covered) for r in spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "v")).collect()} == {(0, True), (9, False)}
