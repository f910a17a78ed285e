"""Source divergence audit: how far the word frequencies of sources of a language lie from each other and from their language.

Terms are counted once, in Arrow batches and then by language and term. A language's kept terms are dealt by hash into slices of
about ``SLICE`` counts, so neither a large language nor a large source is ever one task's. In each slice a source's counts become
a compressed vector; while its terms are at hand, a heap keeps those that stand out most against the language. Then the sources of a
language play a round-robin tournament in each slice. A source's vector has a seat where it stays; in each round one of the two that meet
travels to the other's seat, where both directions are evaluated and added up. Vectors come to a seat in the order
of rounds, one at a time, and at most ``ROUNDS`` rounds are under way at once. What neither of two sources has is added in closed form.

Defined cases: null text, language and source are ''; rows count as documents, repeated or not; every (language, source) that
occurs takes part, also without terms; ties go by the item's UTF-8 bytes; only ``lang``, ``source`` and ``text`` are read, so other
columns can't clash; an empty table gives an empty table. Integers throughout; counts beyond 64 bits of product take Python's.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: What isn't a letter becomes a blank, A-Z lower case; bytes of other scripts stay.
TO_TERMS = bytes(b if b >= 0x80 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
#: Fixed by the definition: unit of probabilities, documents a term needs, ranks of terms.
UNIT, LEAST_DOCUMENTS, MOST_TERMS = 1_000_000_000, 3, 200
#: Terms that a task holds while it counts; counts of a slice, over all its sources; rounds at once.
HELD, SLICE, ROUNDS = 300_000, 1 << 17, 64


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by language, source and term of a part of the rows; a null term stands for the source itself."""
    names = ["lang", "source", "term", "n", "docs"]
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = pa.array([None, *n], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(lang), len(terms)), pa.repeat(pa.scalar(source), len(terms)), terms, pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())], names
            )
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (lang, source) not in held:
                held[lang, source] = Counter(), Counter()
            n, docs = held[lang, source]
            words = text.translate(TO_TERMS).split()
            n.update(words)
            docs.update(set(words))
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from flush()
    yield from flush()


def counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term binary, n, lead`` of terms in enough documents of the language; ``lead`` marks one row a term. A row of null term and n = 0 for each source."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    found = rows.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    # Tasks have added up what they hold; one shuffle by term serves both sums.
    of_term = Window.partitionBy("lang", "term")
    summed = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    known = summed.withColumns({"all": F.sum("docs").over(of_term), "lead": (F.row_number().over(of_term.orderBy("source")) == 1).cast("long")})
    return common.checkpoint(known.where(f"all >= {LEAST_DOCUMENTS} OR term IS NULL").select("lang", "source", "term", "n", F.when(F.col("term").isNull(), 0).otherwise(F.col("lead")).alias("lead")))


def shares(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """p of each count."""
    if len(count) and int(count.max()) >= (1 << 63) // UNIT - 1:
        return np.array([1 + UNIT * (int(c) + 1) // (total + terms) for c in count], np.int64)
    return 1 + UNIT * (count + 1) // (total + terms)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def packed(ids: np.ndarray, count: np.ndarray) -> bytes:
    """Ascending ids as steps, and counts, byte plane by byte plane, compressed."""
    both = np.concatenate([np.diff(ids, prepend=0), count]).astype("<i8")
    return zlib.compress(both.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    both = np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<i8").ravel()
    steps, count = np.split(both, 2)
    return np.cumsum(steps), count


def standing_out(terms: list[bytes], p: np.ndarray, q: np.ndarray) -> list[tuple[int, bytes]]:
    """The first terms by value, largest first, and bytes, of those with p > q: a heap over what can be among them."""
    where = np.flatnonzero(p > q)
    value = divergence(p[where], q[where])
    if len(value) > MOST_TERMS:
        near = value >= np.partition(value, -MOST_TERMS)[-MOST_TERMS]
        where, value = where[near], value[near]
    return [(-v, t) for v, t in heapq.nsmallest(MOST_TERMS, zip((-value).tolist(), (terms[k] for k in where), strict=True))]


SLICED = "lang string, slice int, source string, data binary, item string, value long"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors (no item) and outstanding terms of each source in each slice. Rows come slice by slice: lang, slice, source, term, n, size, all, terms."""

    def of(part: pa.Table) -> Iterator[pa.RecordBatch]:
        part = part.combine_chunks()
        lang, k, terms = part["lang"][0].as_py(), part["slice"][0].as_py(), part["terms"][0].as_py()
        coded, sources = part["term"].combine_chunks().dictionary_encode(), part["source"].combine_chunks().dictionary_encode()
        words, ids, who = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), sources.indices.to_numpy()
        n, size = part["n"].to_numpy(), part["size"].to_numpy()
        whole = np.zeros(len(words), np.int64)
        np.add.at(whole, ids, n)
        q = shares(whole, part["all"][0].as_py(), terms)
        order = np.lexsort((ids, who))
        for mine, source in zip(np.split(order, np.flatnonzero(np.diff(who[order])) + 1), sources.dictionary.to_pylist(), strict=True):
            at = ids[mine]
            best = standing_out([words[i] for i in at], shares(n[mine], int(size[mine[0]]), terms), q[at])
            rows = len(best) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.repeat(pa.scalar(lang), rows),
                    pa.repeat(pa.scalar(k, pa.int32()), rows),
                    pa.repeat(pa.scalar(source), rows),
                    pa.array([packed(at, n[mine]), *[None] * len(best)], pa.binary()),
                    pa.array([None, *(t.decode() for _, t in best)], pa.string()),
                    pa.array([None, *(v for v, _ in best)], pa.int64()),
                ],
                ["lang", "slice", "source", "data", "item", "value"],
            )

    for part in _runs(batches, ("lang", "slice")):
        yield from of(part)


def _runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows of equal ``by``, which follow each other, as one table each."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [batch.column(c).dictionary_encode().indices.to_numpy() for c in by]
        cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            part = batch.slice(a, b - a)
            now = tuple(part.column(c)[0].as_py() for c in by)
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
            key = now
    if held:
        yield pa.Table.from_batches(held)


MET = "lang string, source string, item string, value long, size long, both_lack long, terms long"


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of each meeting. A seat's rows follow each other: its own vector, then its guests by round."""
    seat, ids, count, own = None, None, None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["round"] < 0:
                seat, own, (ids, count) = (row["lang"], row["slice"], row["seat"]), row, unpacked(row["data"])
                continue
            assert seat == (row["lang"], row["slice"], row["seat"]), "a guest has come to an empty seat"
            guest_ids, guest_count = unpacked(row["data"])
            either = np.union1d(ids, guest_ids)
            mine, theirs = np.zeros((2, len(either)), np.int64)
            mine[np.searchsorted(either, ids)] = count
            theirs[np.searchsorted(either, guest_ids)] = guest_count
            terms, none = own["terms"], np.zeros(1, np.int64)
            p, q = shares(mine, own["size"], terms), shares(theirs, row["size"], terms)
            p0, q0 = (shares(none, r["size"], terms) if terms else none + 1 for r in (own, row))
            for one, a, a0, other, b, b0 in ((own, p, p0, row, q, q0), (row, q, q0, own, p, p0)):
                out.append((seat[0], one["source"], other["source"], int(divergence(a, b).sum()), len(either), int(divergence(a0, b0)[0]), terms))
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns[:3]] + [pa.array(c, pa.int64()) for c in columns[3:]], ["lang", "source", "item", "value", "size", "both_lack", "terms"])


def partner(player, players, turn):
    """Whom a player meets in a round of the circle method; itself: nobody. ``players - 1`` rounds if even, else ``players``."""
    modulus = players - 1 + players % 2
    facing = F.pmod(turn - player, modulus)
    last = players - 1
    odd = players % 2 == 1
    return F.when(odd, facing).when(player == last, F.pmod(turn * (players / 2).cast("long"), modulus)).when(facing == player, last).otherwise(facing)


def travels(player, other):
    """Which of two moves: by the parity of their sum the smaller or the larger, so that all move and host about equally often."""
    return (player < other) == ((player + other) % 2 == 0)


def tournament(vectors: DataFrame) -> DataFrame:
    """``lang, source, item, value``: sums over all terms, of all ordered pairs of sources of a language.

    ``vectors`` has ``lang, slice, source, seat, players, size, terms, data``, for each source of a language in each of its slices.
    """
    longest = vectors.agg(F.max("players")).first()[0] or 0
    keep = ["lang", "slice", "seat", "round", "source", "size", "terms", "data"]
    home = vectors.where("players > 1").withColumn("round", F.lit(-1).cast("long"))
    parts = []
    for start in range(0, longest, ROUNDS):
        rounds = F.explode(F.sequence(F.lit(start).cast("long"), F.lit(min(start + ROUNDS, longest) - 1).cast("long")))
        away = home.withColumn("round", rounds).where(F.col("round") < F.col("players") - 1 + F.col("players") % 2)
        away = away.withColumn("to", partner(F.col("seat"), F.col("players"), F.col("round"))).where(F.col("to") != F.col("seat")).where(travels(F.col("seat"), F.col("to")))
        there = home.select(keep).unionByName(away.drop("seat").withColumnRenamed("to", "seat").select(keep))
        met = there.repartition("lang", "slice", "seat").sortWithinPartitions("lang", "slice", "seat", "round").mapInArrow(_meetings, MET)
        met = met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("size").alias("size"), F.first("both_lack").alias("both_lack"), F.first("terms").alias("terms"))
        parts.append(common.checkpoint(met))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "lang string, source string, item string, value long")
    met = parts[0]
    for more in parts[1:]:
        met = met.unionByName(more)
    return met.select("lang", "source", "item", (F.col("value") + (F.col("terms") - F.col("size")) * F.col("both_lack")).alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has the other sources of the language, ``term`` the terms that stand out."""
    known = counts(docs)
    of_lang = Window.partitionBy("lang")
    groups = known.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum("lead").alias("leads"), (F.count("*") - 1).alias("entries"))
    groups = groups.select(
        "lang", "source", "size",
        F.sum("size").over(of_lang).alias("all"),
        F.sum("leads").over(of_lang).alias("terms"),
        F.greatest(F.lit(1), F.ceil(F.sum("entries").over(of_lang) / SLICE)).cast("int").alias("slices"),
        (F.row_number().over(of_lang.orderBy("source")) - 1).cast("long").alias("seat"),
        F.count("*").over(of_lang).alias("players"),
    )
    groups = common.checkpoint(groups)
    names = common.broadcast_if_small(groups, F.length("lang") + F.length("source") + 64)
    rows = known.where("term IS NOT NULL").join(names, ["lang", "source"])
    rows = rows.select("lang", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice"), "source", "term", "n", "size", "all", "terms")
    sliced = common.checkpoint(rows.repartition("lang", "slice").sortWithinPartitions("lang", "slice").mapInArrow(_slices, SLICED))
    seats = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    vectors = seats.join(sliced.where("item IS NULL").select("lang", "slice", "source", "data"), ["lang", "slice", "source"], "left")
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = tournament(vectors).withColumn("rank", F.row_number().over(first)).withColumn("part", F.lit("pair"))
    terms = sliced.where("item IS NOT NULL").select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(first)).where(f"rank <= {MOST_TERMS}").withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, (SELECT count(*) FROM k WHERE k.lang = g.lang) AS v, (SELECT coalesce(sum(n), 0)::BIGINT FROM c WHERE c.lang = g.lang AND c.source = g.source) AS size,
    (SELECT coalesce(sum(total), 0)::BIGINT FROM k WHERE k.lang = g.lang) AS whole FROM g),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000 * (coalesce(n, 0) + 1) // (size + v) AS p, 1 + 1000000000 * (total + 1) // (whole + v) AS q
  FROM s JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200
"""
