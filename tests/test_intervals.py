"""Interval algebra and dependencies against naive loops."""

import random

from tracewright.operators import deps, intervals, iterate


def frame(spark, rows):
    return spark.createDataFrame(rows, "epoch long, rw string, base long, end long")


def test_coalesce_bridge_and_one_apart(spark):
    got = intervals.coalesce(frame(spark, [(1, "READ", 0, 4), (1, "READ", 10, 14), (1, "READ", 4, 10), (2, "READ", 0, 3), (2, "READ", 4, 7)]), "epoch", "rw")
    assert sorted((r.epoch, r.base, r.end, r.ref_count) for r in got.collect()) == [(1, 0, 14, 3), (2, 0, 3, 1), (2, 4, 7, 1)]


def test_subtract_cases(spark):
    a = frame(spark, [(1, "R", 10, 14), (2, "R", 10, 14), (3, "R", 10, 30), (4, "R", 15, 20)])
    b = frame(spark, [(1, "W", 20, 24), (2, "W", 14, 18), (3, "W", 15, 20), (4, "W", 10, 30)])
    got = intervals.subtract(a, b, "epoch")
    assert sorted(tuple(r) for r in got.select("epoch", "base", "end").collect()) == [(1, 10, 14), (2, 10, 13), (3, 10, 14), (3, 21, 30)]


def test_overlaps_match_brute_force(spark):
    rng = random.Random(1)
    make = lambda rw: [(rng.randint(0, 2), rw, b, b + rng.randint(0, 900)) for _ in range(60) if (b := rng.randint(0, 3000)) or True]
    a, b = make("R"), make("W")
    want = sorted((x[0], max(x[2], y[2]), min(x[3], y[3])) for x in a for y in b if x[0] == y[0] and max(x[2], y[2]) <= min(x[3], y[3]))
    got = intervals.overlaps(frame(spark, a), frame(spark, b), "epoch").select("epoch", "lo", "hi")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_known_dependencies(spark):
    s = frame(spark, [(1, "WRITE", 0, 99), (2, "WRITE", 50, 149), (3, "READ", 0, 149), (4, "WRITE", 500, 520), (5, "READ", 500, 520)])
    assert sorted(tuple(r) for r in deps.dependencies(s, "READ").collect()) == [(3, 1), (3, 2)]
    assert sorted(tuple(r) for r in deps.dependencies(s, "WRITE").collect()) == [(2, 1)]


def naive(spans, consumer):
    """Newest first: what a writer explains is taken from the reader's remaining points."""
    out = set()
    for epoch, rw, b, e in spans:
        if rw != consumer:
            continue
        left = set(range(b, e + 1))
        for w in sorted({x[0] for x in spans if x[1] == "WRITE" and x[0] < epoch}, reverse=True):
            for _, _, wb, we in [x for x in spans if x[0] == w and x[1] == "WRITE"]:
                hit = sorted(left & set(range(wb, we + 1)))
                run = 0
                for i, p in enumerate(hit):
                    run = run + 1 if i and hit[i - 1] == p - 1 else 0
                    if run > 32:
                        out.add((epoch, w))
                left -= set(hit)
    return out


def test_dependencies_match_newest_first_loop(spark):
    rng = random.Random(2)
    raw = [(rng.randint(1, 8), rng.choice(["READ", "WRITE"]), b, b + rng.randint(5, 120)) for _ in range(80) for b in [rng.randint(0, 1500)]]
    spans = intervals.coalesce(frame(spark, raw), "epoch", "rw")
    rows = [(r.epoch, r.rw, r.base, r.end) for r in spans.collect()]
    for consumer in ("READ", "WRITE"):
        assert {tuple(r) for r in deps.dependencies(spans, consumer).collect()} == naive(rows, consumer)


def test_accesses_and_temporaries(spark):
    e = spark.createDataFrame([(1, 1, "malloc", 100, None, 50), (1, 2, "store", 100, None, 8), (1, 3, "memcpy", 300, 100, 50), (1, 4, "free", 100, None, 50), (1, 5, "load", 300, None, 4)], "epoch long, seq long, op string, addr long, src long, size long")
    a = intervals.accesses(e)
    assert {(r.rw, r.base, r.end) for r in a.where("type = 'memcpy'").collect()} == {("READ", 100, 149), ("WRITE", 300, 349)}
    kept = intervals.without_temporaries(a)
    assert {(r.rw, r.base, r.end) for r in kept.collect()} == {("WRITE", 300, 349), ("READ", 300, 304)}
    assert intervals.access_pattern(a).first().pattern == "WriteThenRead"


def test_copies_pass_through(spark):
    s = frame(spark, [(1, "WRITE", 1000, 1099), (3, "READ", 5000, 5099)])
    copies = spark.createDataFrame([(2, 1000, 5000, 100)], "epoch long, src long, dst long, size long")
    got = deps.dependencies(deps.with_copies(s, copies), "READ")
    assert [tuple(r) for r in got.collect()] == [(3, 1)]


def test_partitions_follow_the_rows(spark):
    s = frame(spark, [(e, "READ", b, b + 5) for e in range(40) for b in (0, 3, 100)])
    assert iterate.partitions(s, rows=10) == 12
    assert iterate.partitions(s, rows=1000) == 4
    got = intervals.coalesce(s, "epoch", "rw", partitions=12)
    assert got.rdd.getNumPartitions() == 12 and got.count() == 80
    less = intervals.subtract(s, s.where("base = 3"), "epoch", partitions=12)
    assert less.rdd.getNumPartitions() == 12 and less.count() == 80
