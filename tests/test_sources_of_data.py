"""Whose data an epoch uses: explained parts, copies over several hops, false pairs; against sets of points, newest writer first."""

import random

import pytest

from tracewright.operators import deps, intervals

SPANS = "epoch long, rw string, base long, end long"
COPIES = "epoch long, dst long, dst_end long, src long, src_end long"


def runs(points):
    """Stretches of a set of points, as (first, last)."""
    out = []
    for p in sorted(points):
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return out


def plain(spans, copies, consumer="READ", longer_than=32):
    """{(epoch, writer): least hops}; spans are (epoch, rw, base, end[, pattern])."""
    writes = [s for s in spans if s[1] == "WRITE"]
    both = lambda s: len(s) > 4 and s[4] == "WriteThenRead"
    got = {}
    for epoch in {s[0] for s in spans if s[1] == consumer}:
        wanted = {}
        for s in spans:
            if s[0] == epoch and s[1] == consumer:
                older = [w[0] for w in writes if both(w) and w[0] < epoch]
                wanted[(epoch - 1, s[2])] = (set(range(s[2], s[3] + 1)), max(older, default=None) if both(s) else None)
        seen, explained, hop = {}, {}, 0
        while wanted:
            more = {}
            for (upto, own), (rest, since) in wanted.items():
                rest = set(rest)
                for writer in sorted({w[0] for w in writes if w[0] <= upto}, reverse=True):
                    if since is not None and writer < since:
                        break
                    for w in [w for w in writes if w[0] == writer]:
                        hit = rest & set(range(w[2], w[3] + 1))
                        rest -= hit
                        if not hit or (since == writer and both(w)):
                            continue
                        for p in hit:
                            explained.setdefault((upto, own, writer, w[2]), {}).setdefault(p, hop)
                        for _, dst, dst_end, src, src_end in [c for c in copies if c[0] == writer and consumer == "READ"]:
                            part = {p for p in hit if dst <= p <= dst_end}
                            if part:
                                back = {p + src - dst for p in part} if src_end - src == dst_end - dst else set(range(src, src_end + 1))
                                more.setdefault((writer, None), set()).update(back)
            wanted = {}
            for k, points in more.items():
                fresh = points - seen.setdefault(k, set())
                seen[k] |= fresh
                if fresh:
                    wanted[k] = (fresh, None)
            hop += 1
        for (_, _, writer, _), points in explained.items():
            for lo, hi in runs(points):
                if hi - lo > longer_than:
                    hops = min(points[p] for p in range(lo, hi + 1))
                    got[(epoch, writer)] = min(hops, got.get((epoch, writer), hops))
    return got


def found(df):
    rows = df.collect()
    assert len({(r.epoch, r.writer) for r in rows}) == len(rows)
    return {(r.epoch, r.writer): r.hops for r in rows}


def test_a_chain_of_three_copies(spark):
    spans = [(1, "WRITE", 0, 99), (2, "WRITE", 1000, 1099), (3, "WRITE", 2000, 2099), (4, "WRITE", 3000, 3099), (9, "READ", 3000, 3099)]
    copies = [(2, 1000, 1099, 0, 99), (3, 2000, 2099, 1000, 1099), (4, 3000, 3099, 2000, 2099)]
    got = found(deps.sources(spark.createDataFrame(spans, SPANS), spark.createDataFrame(copies, COPIES)))
    assert got == {(9, 4): 0, (9, 3): 1, (9, 2): 2, (9, 1): 3} == plain(spans, copies)


def test_copies_in_a_circle_end_and_short_stretches_explain_without_an_edge(spark):
    spans = [(1, "WRITE", 0, 99), (2, "WRITE", 0, 99), (2, "WRITE", 1000, 1099), (3, "WRITE", 0, 20), (5, "READ", 0, 52)]
    copies = [(2, 1000, 1099, 0, 99), (2, 0, 99, 1000, 1099)]
    got = found(deps.sources(spark.createDataFrame(spans, SPANS), spark.createDataFrame(copies, COPIES)))
    assert got == plain(spans, copies) and (5, 3) not in got
    # 21..52 is 31 long: short of an edge from epoch 2.
    assert got == {}


def test_write_then_read_drops_the_span_at_the_newest_such_writer(spark):
    p = SPANS + ", pattern string"
    wtr = "WriteThenRead"
    spans = [(1, "WRITE", 0, 99, "Write"), (2, "WRITE", 500, 599, wtr), (3, "WRITE", 0, 49, "Write"), (5, "READ", 0, 99, wtr), (6, "READ", 0, 99, "Read")]
    assert found(deps.sources(spark.createDataFrame(spans, p))) == {(5, 3): 0, (6, 3): 0, (6, 1): 0} == plain(spans, [])


@pytest.mark.parametrize("seed", range(2))
def test_random_spans_and_copies(spark, seed):
    rng = random.Random(seed)
    copies, raw = [], []
    for _ in range(25):
        e, d, s, n = rng.randint(1, 9), rng.randint(0, 1200), rng.randint(0, 1200), rng.randint(20, 120)
        copies.append((e, d, d + n, s, s + rng.choice([n, n, n + 40])))
        raw += [(e, "WRITE", d, d + n), (e, "READ", s, copies[-1][4])]
    for _ in range(50):
        b = rng.randint(0, 1400)
        raw.append((rng.randint(1, 9), rng.choice(["READ", "WRITE"]), b, b + rng.randint(5, 120)))
    spans = intervals.coalesce(spark.createDataFrame(raw, SPANS), "epoch", "rw")
    rows = [(r.epoch, r.rw, r.base, r.end, rng.choice(["WriteThenRead", "Write", "Read"])) for r in spans.collect()]
    c = spark.createDataFrame(copies, COPIES)
    with_pattern = spark.createDataFrame(rows, SPANS + ", pattern string")
    assert found(deps.sources(with_pattern, c, bucket=2)) == plain(rows, copies)
    bare = [r[:4] for r in rows]
    for consumer in ("READ", "WRITE"):
        got = found(deps.sources(spans, None, consumer))
        assert got == plain(bare, [], consumer)
        assert set(got) == {tuple(r) for r in deps.dependencies(spans, consumer).collect()}


def test_nulls_and_empty_tables(spark):
    rows = [(None, "WRITE", 0, 99), (1, "WRITE", None, 99), (2, "READ", 0, 99)]
    assert found(deps.sources(spark.createDataFrame(rows, SPANS), spark.createDataFrame([(None, 0, 1, 2, 3)], COPIES))) == {}
    assert found(deps.sources(spark.createDataFrame([], SPANS))) == {}


def test_sources_of_copies_that_name_none(spark):
    rows = [(1, "READ", "memcpy", 0, 40), (1, "READ", "reader", 100, 180), (1, "WRITE", "memcpy", 120, 200), (2, "READ", "reader", 0, 9), (2, "READ", "memmove", 50, 150), (2, "WRITE", "memmove", 300, 360), (3, "WRITE", "memcpy", 0, 90)]
    got = deps.copy_targets(spark.createDataFrame(rows, "epoch long, rw string, type string, base long, end long"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 120, 200, 100, 180), (2, 300, 360, 50, 150)]


def test_patterns_of_overlapping_accesses(spark):
    rows = [(1, 1, "WRITE", 0, 9), (1, 2, "READ", 5, 20), (1, 3, "READ", 100, 110), (1, 4, "WRITE", 110, 120), (1, 5, "READ", 200, 210), (2, 6, "WRITE", 0, 9)]
    got = intervals.patterned(spark.createDataFrame(rows, "epoch long, seq long, rw string, base long, end long"))
    want = {(1, "WRITE", 0, 9, "WriteThenRead"), (1, "READ", 5, 20, "WriteThenRead"), (1, "READ", 100, 110, "ReadThenWrite"), (1, "WRITE", 110, 120, "ReadThenWrite"), (1, "READ", 200, 210, "Read"), (2, "WRITE", 0, 9, "Write")}
    assert {(r.epoch, r.rw, r.base, r.end, r.pattern) for r in got.collect()} == want


def test_a_stretch_of_one_writer_is_one_row(spark):
    writes = [(e, b, b + 9, False) for e in range(1, 5) for b in range(e, 200, 20)] + [(5, 0, 99, True)]
    w = spark.createDataFrame(writes, "epoch long, base long, end long, both boolean")
    asked = spark.createDataFrame([(8, 7, 0, None, 0, 99), (4, 3, 300, None, 300, 310), (None, 4, None, None, 0, 3)], "epoch long, upto long, own long, since long, base long, end long")
    rows = [(r.epoch, r.writer, r.w_base, r.lo, r.hi, r.both) for r in deps.explain(w, asked, 64).collect()]
    # Four hundred end points lie under the first consumer, which one writer explains: a row for each bin.
    assert sorted(r for r in rows if r[0] == 8) == [(8, 5, 0, 0, 63, True), (8, 5, 0, 64, 99, True)]
    assert [r for r in rows if r[0] == 4] == []
    assert sorted(r[1:5] for r in rows if r[0] is None) == [(1, 1, 1, 1), (2, 2, 2, 2), (3, 3, 3, 3)]


def test_the_newest_edge_goes_on_over_bins(spark):
    spans = [(1, "WRITE", 0, 999), (2, "READ", 40, 90), (3, "READ", 63, 64), (4, "WRITE", 100, 110), (5, "READ", 80, 140)]
    df = spark.createDataFrame(spans, SPANS)
    for width in (16, 64, 256):
        assert found(deps.sources(df, width=width)) == {(2, 1): 0} == plain(spans, [])
        assert [tuple(r) for r in deps.dependencies(df, width=width).collect()] == [(2, 1)]


@pytest.mark.parametrize("longer_than", [32, 0, 7])
def test_reads_meet_copies_at_points_that_they_share(spark, longer_than):
    rng = random.Random(longer_than)
    spans = [(rng.randint(1, 9), rng.choice(["READ", "READ", "WRITE"]), b, b + rng.randint(0, 90)) for _ in range(120) for b in [rng.randint(-300, 3000)]]
    copies = [(rng.randint(1, 9), rng.randint(0, 3000), rng.randint(-300, 3000), rng.randint(0, 90)) for _ in range(120)]
    want = {(e, max(b, d) + s - d, min(x, d + n - 1) + s - d) for e, rw, b, x in spans if rw == "READ" for c, s, d, n in copies if c < e and min(x, d + n - 1) - max(b, d) > longer_than}
    c = spark.createDataFrame(copies, "epoch long, src long, dst long, size long")
    s = spark.createDataFrame(spans, SPANS)
    got = deps.inherited(s, c, longer_than)
    assert sorted((r.epoch, r.base, r.end) for r in got.collect()) == sorted(want)
    assert deps.with_copies(s, c, longer_than).count() == len(spans) + len(want)
