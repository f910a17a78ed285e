"""The filter audit against its plain form and its SQL."""

import random
from collections import Counter
from itertools import permutations

import duckdb
import pytest
from brute import SF

from tracewright.llm import filters


def failing(rows):
    """Letters of the filters that each row fails."""
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, _, t in rows:
        t = t or ""
        words = t.encode().split()
        out.append(
            "A" * (len(words) < 200)
            + "B" * (100 * len(set(words)) < 50 * len(words))
            + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t))
            + "D" * any(c in "#$%&*|" for c in t)
            + "E" * (i is not None and least[t] < i)
        )
    return out


def plain(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, x in labels if x == 1 and i is not None}
    fails = failing(rows)
    out = {}
    for part in {r[1] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[1] or "") == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                gone, left = [x for x in left if letter in x[1]], [x for x in left if letter not in x[1]]
                fail = [x for x in mine if letter in x[1]]
                shapley[letter] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(fail) - len(gone), sum(f == letter for _, f in mine), sum(i in good for i, _ in gone), sum(i in bad for i, _ in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def collected(df):
    return {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}


def odd_rows():
    rng = random.Random(13)
    words = [f"w{n}" for n in range(400)] + ["Ab", "é😀", "A|B", "100%"]
    texts = [" ".join(rng.choices(words[: rng.choice((60, 404))], k=rng.choice((0, 5, 199, 200, 201, 300)))) for _ in range(40)]
    texts += ["A" * 2 + "b" * 98, "A" * 2 + "b" * 97, "AA" + "é" * 98, None, "", " \n", "x " * 100_000, *texts[:20]]
    rows = [(rng.choice((n, n % 17)), rng.choice(("s", "t", None, "")), t) for n, t in enumerate(texts)]
    rows += [(None, "s", texts[0]), (None, "s", texts[0]), (3, "t", texts[1]), (3, "t", texts[1]), (None, None, None)]
    labels = [(n, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for n in (*range(0, 40, 2), 4, 4, 6, None, 1000)]
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "z", 1, 2) for r in rows], "doc_id long, source string, text string, part string, n int, label int").repartition(3)
    return docs, spark.createDataFrame([(*r, 5) for r in labels], "doc_id long, quality int, toxic int, bits int")


def test_odd_rows(spark):
    rows, labels = odd_rows()
    docs, marks = frames(spark, rows, labels)
    assert collected(filters.audit(docs, marks)) == plain(rows, labels)
    assert filters.audit(docs.limit(0), marks).count() == 0
    assert collected(filters.audit(docs, marks.limit(0))) == plain(rows, [])


def test_more_parts_than_a_task_keeps(spark, monkeypatch):
    rows, labels = odd_rows()
    rows = [(i, f"p{n % 9}", t) for n, (i, _, t) in enumerate(rows)]
    monkeypatch.setattr(filters, "PARTS", 2)
    assert collected(filters.audit(*frames(spark, rows, labels))) == plain(rows, labels)


def test_table():
    table = filters.first_failures()
    assert table.shape == (32, 120)
    for bits in range(32):
        for k, order in enumerate(filters.ORDERS):
            assert table[bits, k] == next((s for s, c in enumerate(order) if bits >> "ABCDE".index(c) & 1), 5)


@pytest.mark.parametrize("sf", [SF])
def test_sql(spark, sf):
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = filters.op13_filters(spark, sf)
    assert sorted(map(tuple, df.collect())) == sorted(duck.execute(f"SELECT {', '.join(df.columns)} FROM ({filters.ORACLE})").fetchall())
