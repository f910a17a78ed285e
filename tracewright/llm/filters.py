"""Filter interaction audit: what each filter removes in every order of application.

A document's failures are five bits. A table fixed beforehand has, for each of the 32 sets of failures and each of the 120
orders, the step at which the set first fails. One pass over the texts yields the bits of four filters and a digest; joins by id and
digest add the labels and the fifth bit (a smaller id has the same text). ``mapInArrow`` then looks the rows up in the
table and adds up, by part, order, step and label, what is removed; the arrays of all tasks are summed.
Everything else follows from the removals: what reaches a step, what fails a filter (its removals as first
filter of an order), what fails it alone (its removals as the last).

Defined cases: null text is empty, null source is ''; rows of one id and one text are equal to each other, not to a smaller id; a
null id is smaller than none and has no smaller one; a document is good (toxic) if any label of its id says so;
only ``doc_id``, ``source`` and ``text`` are read, so other columns can't clash; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: Limits of the filters, fixed by their definition.
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, b"#$%&*|"
CAPITALS = common.UPPER.encode()
CONTINUATION = bytes(range(0x80, 0xC0))
#: Parts for which a task keeps counts at once; 46 KB each.
PARTS = 1_000


def first_failures() -> np.ndarray:
    """Step from 0 at which each of the 32 sets of failures (bit k: filter k) fails first in each of the 120 orders; 5: never."""
    order = np.array([[FILTERS.index(c) for c in o] for o in ORDERS])
    fails = (np.arange(1 << STEPS)[:, None, None] >> order) & 1
    return np.where(fails.any(2), fails.argmax(2), STEPS)


def failures(text: bytes) -> int:
    """Bits of the filters that look at one text alone (A, B, C, D)."""
    words = text.split()
    return (
        (len(words) < FEWEST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
        | (100 * (len(text) - len(text.translate(None, CAPITALS))) > MOST_CAPITALS * len(text.translate(None, CONTINUATION))) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in batch.column(2).to_pylist()]
        bits = pa.array(map(failures, texts), pa.int32())
        digest = pa.array((hashlib.sha256(t).digest() for t in texts), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bits, digest], ["doc_id", "part", "bits", "digest"])


def failed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, bits, label, n``: rows of equal id, text and part as one, with their failures, and 1 if good plus 2 if toxic."""
    common.small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    seen = rows.mapInArrow(_texts, f"doc_id {kind}, part string, bits int, digest binary")
    seen = common.checkpoint(seen.groupBy("doc_id", "digest", "part", "bits").agg(F.count("*").alias("n")))
    # A row meets its text's least id by digest and id, so a text of many copies is no hot key; rows without an id meet nothing.
    first = seen.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    label = labels.groupBy("doc_id").agg((F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)) + 2 * F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0))).alias("label"))
    known = seen.where("doc_id IS NOT NULL").join(first, ["digest", "doc_id"], "left").join(label, "doc_id", "left")
    known = known.select("part", (F.col("bits") + F.when(F.col("first"), 0).otherwise(1 << STEPS - 1)).alias("bits"), F.coalesce("label", F.lit(0)).alias("label"), "n")
    return known.unionByName(seen.where("doc_id IS NULL").select("part", "bits", F.lit(0).alias("label"), "n"))


def _removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = first_failures()
    shape = (len(ORDERS), STEPS + 1, 4)
    cell = np.arange(len(ORDERS)) * (STEPS + 1)
    sums: dict[str, np.ndarray] = {}

    def partial() -> Iterator[pa.RecordBatch]:
        names = pa.array(np.repeat(ORDERS, STEPS + 1))
        steps = pa.array(np.tile(np.arange(1, STEPS + 2, dtype=np.int32), len(ORDERS)))
        for part, counts in sums.items():
            by = counts.reshape(-1, 4)
            columns = [by.sum(1), by[:, 1] + by[:, 3], by[:, 2] + by[:, 3]]
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(part), len(steps)), names, steps, *map(pa.array, columns)], ["part", "filter_order", "step", "removed", "good_lost", "toxic_lost"])
        sums.clear()

    for batch in batches:
        parts, n = batch.column(0).dictionary_encode(), batch.column(3).to_numpy()
        at, bits, label = (x.to_numpy(zero_copy_only=False) for x in (parts.indices, batch.column(1), batch.column(2)))
        for k, part in enumerate(parts.dictionary.to_pylist()):
            if part not in sums:
                if len(sums) >= PARTS:
                    yield from partial()
                sums[part] = np.zeros(np.prod(shape), np.int64)
            mine = at == k
            where = (cell + table[bits[mine]]) * 4 + label[mine, None]
            # Weights are doubles: exact, as a batch stands for fewer than 2**53 rows.
            sums[part] += np.bincount(where.ravel(), np.repeat(n[mine], len(ORDERS)), np.prod(shape)).astype(np.int64)
    yield from partial()


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step: what is kept after the step, and what its filter does there and in all."""
    found = failed(docs, labels).mapInArrow(_removals, "part string, filter_order string, step int, removed long, good_lost long, toxic_lost long")
    sums = found.groupBy("part", "filter_order", "step").agg(*(F.sum(c).alias(c) for c in ("removed", "good_lost", "toxic_lost")))
    sums = common.checkpoint(sums.withColumn("letter", F.substr("filter_order", F.col("step"), F.lit(1))))
    of = sums.where(F.col("step") <= STEPS).groupBy("part", "letter")
    # As first filter it removes all that fail it, as last all that fail it alone.
    of = of.agg(F.max(F.when(F.col("step") == 1, F.col("removed"))).alias("fails"), F.max(F.when(F.col("step") == STEPS, F.col("removed"))).alias("unique_fails"), F.sum("removed").alias("shapley"))
    later = Window.partitionBy("part", "filter_order").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sums.withColumn("kept", F.sum("removed").over(later))
        .where(F.col("step") <= STEPS)
        .join(of, ["part", "letter"])
        .select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
    )


def op13_filters(spark, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
f AS (SELECT doc_id, part,
    (len(words) < 200)::INT AS a,
    (100 * len(list_distinct(words)) < 50 * len(words))::INT AS b,
    (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT AS c,
    regexp_matches(t, '[#$%&*|]')::INT AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS e
  FROM w),
g AS (SELECT part, a, b, c, d, e, count(*) AS n,
    count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL)) AS good,
    count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)) AS bad
  FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
x AS (SELECT part, n, good, bad, concat(CASE WHEN a = 1 THEN 'A' END, CASE WHEN b = 1 THEN 'B' END, CASE WHEN c = 1 THEN 'C' END, CASE WHEN d = 1 THEN 'D' END, CASE WHEN e = 1 THEN 'E' END) AS fails FROM g),
r AS (SELECT part, filter_order, step, letter,
    sum(CASE WHEN length(translate(fails, earlier || letter, '')) = length(fails) THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN contains(fails, letter) AND length(translate(fails, earlier, '')) = length(fails) THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN contains(fails, letter) AND length(translate(fails, earlier, '')) < length(fails) THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = letter THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN contains(fails, letter) AND length(translate(fails, earlier, '')) = length(fails) THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN contains(fails, letter) AND length(translate(fails, earlier, '')) = length(fails) THEN bad ELSE 0 END)::BIGINT AS toxic_lost
  FROM x, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM r
"""
