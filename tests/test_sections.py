"""Nested instances and running values against plain loops over random traces."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracewright.operators import epochs, metrics, running, sections, trace

HIERARCHY = [("a", "b"), ("b", "c"), ("a", "d")]
MEMBERS = [("1", "a"), ("2", "b"), ("3", "c"), ("4", "d"), ("5", "e"), ("3", "e")]


def rows(seed, n=400, threads=3):
    r = random.Random(seed)
    return [(r.randrange(threads) or None, r.randrange(60) * 20, i, r.choice("1234567")) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "thread long, ts long, seq long, block string")


def plain(data):
    up = {c: p for p, c in HIERARCHY}
    of = defaultdict(set)
    for block, s in MEMBERS:
        while s:
            of[block].add(s)
            s = up.get(s)
    by = defaultdict(list)
    for t, ts, seq, b in data:
        by[t].append((ts, seq, b))
    out, heads, turned = {}, set(), []
    for t, steps in by.items():
        made, current, was = defaultdict(int), {}, set()
        for ts, seq, b in sorted(steps):
            now = of[b]
            for s in sorted(now, key=lambda s: "abcde".index(s)):  # parents come first
                if s in was:
                    turned.append((current[s], s, b))
                else:
                    heads.add((s, b))
                    p = current[up[s]] if s in up else None
                    if p is None or s not in current or out[current[s]]["parent"] != p:
                        made[s] += 1
                        current[s] = (t, s, made[s])
                        out[current[s]] = {"parent": p, "entries": 0, "iterations": 0, "steps": 0, "at": (ts, seq)}
                    out[current[s]]["entries"] += 1
                out[current[s]]["steps"] += 1
            was = now
    for key, s, b in turned:
        out[key]["iterations"] += (s, b) in heads
    return {(*k, v["parent"] and v["parent"][1], v["parent"] and v["parent"][2], v["entries"], v["iterations"], v["steps"], *v["at"]) for k, v in out.items()}


@pytest.mark.parametrize("bucket", [None, 100])
def test_instances(spark, bucket):
    data = rows(5)
    m, h = spark.createDataFrame(MEMBERS, "block string, section string"), spark.createDataFrame(HIERARCHY, "parent string, child string")
    tree = sections.instance_tree(frame(spark, data), m, h, bucket)
    assert {tuple(r) for r in tree.collect()} == plain(data)


def test_documents_and_runs(spark):
    import json

    data = rows(6)
    m, h = spark.createDataFrame(MEMBERS, "block string, section string"), spark.createDataFrame(HIERARCHY, "parent string, child string")
    tree = sections.instance_tree(frame(spark, data), m, h)
    seen = set()

    def walk(thread, node, above):
        seen.add((thread, node["section"], node["instance"], *above))
        for child in node["children"]:
            walk(thread, child, (node["section"], node["instance"]))

    for r in sections.hierarchy_documents(tree).collect():
        walk(r.thread, json.loads(r.document), (None, None))
    assert seen == {r[:5] for r in plain(data)}

    by, want = defaultdict(list), defaultdict(int)
    for t, ts, seq, b in data:
        by[t].append((ts, seq, b))
    for steps in by.values():
        run = []
        for b in [b for _, _, b in sorted(steps)] + ["1"]:
            if b in "67":
                run.append(b)
            elif run:
                want[tuple(sorted(set(run))), run[0]] += 1
                run = []
    for bucket in (None, 100):
        got = sections.outside_runs(frame(spark, data), m, bucket)
        assert {(tuple(r.blocks), r.first_block): r.runs for r in got.collect()} == want


def test_bad_hierarchies(spark):
    m = spark.createDataFrame([("1", "a")], "block string, section string")
    for pairs in ([("a", "b"), ("b", "a")], [("a", "c"), ("b", "c")]):
        with pytest.raises(ValueError):
            sections.lineage(m, spark.createDataFrame(pairs, "parent string, child string"))
    nothing = spark.createDataFrame([], "parent string, child string")
    t = frame(spark, [])
    assert sections.instance_tree(t, m, nothing).count() == 0 and sections.outside_runs(t, m).count() == 0


def test_buckets_change_nothing(spark):
    """Previous values, sums and peaks with nulls, and the operators built on them, with threads cut by time and whole."""
    data = [(*r, None if r[2] % 5 == 0 else r[2] % 7) for r in rows(7)]
    t = spark.createDataFrame(data, "thread long, ts long, seq long, block string, v long")
    pairs = spark.createDataFrame([("1", "2"), ("3", "1")], "src string, snk string")
    m = spark.createDataFrame(MEMBERS, "block string, section string")
    labels = t.withColumn("push", F.when(F.col("block") == "1", F.col("seq").cast("string"))).withColumn("pop", F.col("block") == "2")
    forms = [
        lambda b: running.previous(t, "v", "o", bucket_seconds=b),
        lambda b: running.total(t, F.col("v"), "o", bucket_seconds=b),
        lambda b: running.peak(t, F.col("v"), "o", bucket_seconds=b),
        lambda b: epochs.assign(t, pairs, bucket_seconds=b),
        lambda b: epochs.sections(t, m, bucket_seconds=b).select("thread", "seq", *(F.array_sort(c).alias(c) for c in ("entered", "left", "continued"))),
        lambda b: epochs.instances(epochs.sections(t, m, bucket_seconds=b), bucket_seconds=b),
        lambda b: trace.states(t, 3, bucket_seconds=b),
        lambda b: trace.active_labels(labels, bucket_seconds=b),
        lambda b: metrics.high_water(t.withColumnRenamed("v", "bytes"), bucket_seconds=b),
    ]
    for form in forms:
        whole, cut = form(None), form(90)
        assert set(whole.columns) == set(cut.columns)
        key = lambda df: sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
        assert key(whole) == key(cut)


def test_sorted_rows_hold_no_sections(spark):
    trace = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 2, "b")], "thread long, ts long, seq long, block string")
    members = spark.createDataFrame([("a", "s"), ("b", "s")], "block string, section string")
    kin = sections.lineage(members, spark.createDataFrame([], "parent string, child string"))
    live = sections._live(trace, members, kin, None)
    plan = live._jdf.queryExecution().optimizedPlan().toString()
    # Rows are sorted first and meet their sections, and those of the block before, afterwards.
    assert plan.index("Join") < plan.index("Window")
    assert sorted((r.seq, len(r.now), len(r.was)) for r in live.collect()) == [(1, 1, 0), (2, 1, 1)]
