"""The divergence audit against its plain form and its SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from brute import SF
from pyspark.sql import functions as F

from tracewright.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows):
    """{(lang, source, part, item): (value, rank)}."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    count, documents = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = TERM.findall((text or "").translate(lower))
        count[lang or "", source or ""].update(words)
        documents[lang or ""].update(set(words))
    out = {}
    for lang in documents:
        kept = [t for t, n in documents[lang].items() if n >= 3]
        mine = {s: c for (la, s), c in count.items() if la == lang}
        whole = Counter({t: sum(c[t] for c in mine.values()) for t in kept})

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in mine.items()}, share(whole)
        for s, c in mine.items():
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in mine if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if c[t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 200)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out[lang, s, part, item] = value, rank
    return out


def audited(df):
    rows = divergence.audit(df).collect()
    found = {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in rows}
    assert len(found) == len(rows)
    return found


def odd_rows():
    rng = random.Random(12)
    words = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "uvwxyzäé"] + ["Word", "WORD", "naïve", "x1y", "梦想", "😀"]
    rows = []
    for lang, sources in (("en", 7), ("de", 6), ("fr", 2), ("it", 1), (None, 3)):
        for s in range(sources):
            rows += [(lang, f"s{s}" if s else None, " ".join(rng.choices(words[s * 5 :], k=rng.randrange(60)))) for _ in range(8)]
    rows += [("en", "silent", None), ("en", "silent", ""), ("en", "digits", "1 2 3 !?"), ("de", "rare", "onlyonce"), ("xx", "a", "lone"), ("xx", "b", None), ("xx", "c", "words here"), ("", "", "same same")]
    rows += [("en", "s1", "long " * 50_000 + "tail"), ("en", "s1", "ab" * 20_000)] + [rows[3]] * 3
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(n, *r, "z", 1, b"d") for n, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, n int, data binary").repartition(5)


def test_odd_rows(spark):
    rows = odd_rows()
    assert audited(frame(spark, rows)) == plain(rows)
    assert audited(frame(spark, rows).limit(0)) == {}


def test_slices_and_rounds(spark, monkeypatch):
    """Many slices, one round at a time, and tasks that hold little, give the same."""
    monkeypatch.setattr(divergence, "SLICE", 40)
    monkeypatch.setattr(divergence, "ROUNDS", 2)
    monkeypatch.setattr(divergence, "HELD", 10)
    monkeypatch.setattr(divergence.common, "broadcast_if_small", lambda df, size: df.hint("merge"))
    rows = odd_rows()
    assert audited(frame(spark, rows)) == plain(rows)


def test_more_terms_than_ranks_and_ties(spark):
    rows = [("en", f"s{k % 3}", " ".join(f"{a}{b}{'é' * (k % 2)}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnop" if (ord(a) + k) % 3)) for k in range(12)]
    got = audited(frame(spark, rows))
    assert got == plain(rows)
    assert max(r for (_, _, part, _), (_, r) in got.items() if part == "term") == 200


@pytest.mark.parametrize("players", [2, 3, 4, 7, 8, 13, 20])
def test_tournament_schedule(spark, players):
    """Every two meet once, nobody twice in a round, one of two travels, and travel is shared."""
    turns = players - 1 + players % 2
    rows = spark.range(players).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))).alias("turn"))
    rows = rows.withColumn("other", divergence.partner(F.col("k"), F.lit(players).cast("long"), F.col("turn"))).withColumn("moves", divergence.travels(F.col("k"), F.col("other")))
    met = [r for r in rows.collect() if r.k != r.other]
    assert Counter((min(r.k, r.other), max(r.k, r.other)) for r in met) == {(a, b): 2 for a in range(players) for b in range(a + 1, players)}
    assert len({(r.k, r.turn) for r in met}) == len(met)
    assert {(r.other, r.k, r.turn) for r in met} == {(r.k, r.other, r.turn) for r in met}
    moves = [(r.k, r.other) for r in met if r.moves]
    assert len(moves) == players * (players - 1) // 2 == len({frozenset(m) for m in moves})
    assert max(Counter(k for k, _ in moves).values()) <= players // 2 + 1


def test_large_counts_stay_exact():
    count = np.array([0, 5, 9_300_000_000, 10**15], np.int64)
    assert divergence.shares(count, 2 * 10**15, 3).tolist() == [1 + 10**9 * (int(c) + 1) // (2 * 10**15 + 3) for c in count]


def test_vectors_survive_packing():
    for ids, count in (([], []), ([0], [1]), ([0, 7, 1 << 40], [5, 1 << 50, 2])):
        got = divergence.unpacked(divergence.packed(np.array(ids, np.int64), np.array(count, np.int64)))
        assert [a.tolist() for a in got] == [ids, count]


def test_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = divergence.op12_divergence(spark, SF)
    assert sorted(map(tuple, df.collect())) == sorted(duck.execute(f"SELECT {', '.join(df.columns)} FROM ({divergence.ORACLE})").fetchall())
