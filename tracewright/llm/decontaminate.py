"""Benchmark decontamination by winnowing, in built-in functions only.

A test item's windows are its runs of ``WINDOW`` words; a shorter item is one window.
Each text is fingerprinted by winnowing: of every ``SPAN`` consecutive ``GRAM``-word
hashes the least is kept with its position. ``GRAM + SPAN - 1 = WINDOW``, so any
``WINDOW`` words that two texts share contain a kept hash that both texts kept: no shared
window is missed. Fingerprints of documents meet those of the items; every hit is extended
to the windows around it, which are compared word by word. Items shorter than a window have
one fingerprint, the hash of all their words, and documents keep all hashes of those
lengths (at most WINDOW - 1 lengths, looked up first).

A fingerprint is one long: 33 bits of hash above 30 bits of word position, so that a
minimum carries its place. The item side is broadcast if its measured size allows, else
both sides are shuffled. A window carries the set of the ids of all items that hold it, and meets
documents once.

Defined cases: null or wordless texts have no windows and no hits; null or repeated ids are
rows of their own (rows equal in id and text share one result each); an empty benchmark
leaves every document clean; items with null id count under no id; an item id on several texts
counts once; of equal least hashes in a span the leftmost is kept; texts of any length are taken
whole, up to 2**30 words; only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import let

WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
PLACE_BITS = 30
#: Everything but letters, digits and what lies beyond ASCII.
BREAK = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def tokens(text: Column) -> Column:
    return F.filter(F.split(common.lower_ascii(F.coalesce(text, F.lit(""))), f"[{BREAK}]+"), lambda w: w != "")


def _places(w: Column, k: int) -> Column:
    """Packed hash and position of each ``k``-word run of ``w``; null if there is none."""
    packed = lambda i: F.shiftrightunsigned(F.xxhash64(F.lit(k), *(F.get(w, i + j) for j in range(k))), 64 - 33).bitwiseOR(F.lit(0)) * F.lit(1 << PLACE_BITS) + i
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), packed))


def _winnow(w: Column) -> Column:
    """The least packed hash of every SPAN consecutive ones; each once."""
    none = F.array().cast("array<bigint>")
    half = SPAN // 2
    # Minima of half a span first, then of two halves; ``least`` passes over the nulls beyond the end.
    halves = lambda h: F.transform(h, lambda x, i: F.least(x, *(F.get(h, i + j) for j in range(1, half))))
    whole = lambda m: F.transform(F.slice(m, 1, F.size(m) - SPAN + 1), lambda x, i: F.least(x, F.get(m, i + half)))
    least = lambda h: F.array_distinct(let(halves(h), whole))
    return F.coalesce(let(_places(w, GRAM), lambda h: F.when(F.size(h) >= SPAN, least(h))), none)


def _prints(w: Column, short: list[int]) -> Column:
    none = F.array().cast("array<bigint>")
    return F.concat(_winnow(w), *(F.coalesce(_places(w, k), none) for k in short))


def _run(w: Column, start: Column, length: Column) -> Column:
    """The words themselves; they hold no blank."""
    return F.array_join(F.slice(w, start + 1, length), " ")


def item_texts(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``words, ids``: the items of equal words as one, with their distinct ids as strings."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), tokens(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    return items.groupBy("words").agg(F.collect_set("item").alias("ids"))


def item_windows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``window, set_id`` of every window of ``item_texts``, and ``set_id, item``: the ids that hold the windows of that set."""
    length = F.least(F.size("words"), F.lit(WINDOW))
    windows = let(F.col("words"), lambda w: F.transform(F.sequence(F.lit(0), F.size("words") - length), lambda i: _run(w, i, length)))
    each = items.select(F.explode(F.array_distinct(windows)).alias("window"), "ids")
    held = each.groupBy("window").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    held = common.checkpoint(held.withColumn("set_id", F.sha2(F.array_join(F.transform("ids", lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), ",").cast("binary"), 256)))
    sets = held.groupBy("set_id").agg(F.first("ids").alias("ids"))
    return held.select("window", "set_id"), sets.select("set_id", F.explode("ids").alias("item"))


def fingerprints(docs: DataFrame, short: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, n_words, prints`` of every row."""
    about = let(tokens(F.col(text_col)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _prints(w, short).alias("prints")))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), about.alias("about")).select("doc_id", "text_hash", "about.*")


def short_lengths(items: DataFrame) -> list[int]:
    """Lengths of the items below a window: at most WINDOW - 1 numbers."""
    return sorted(r[0] for r in items.select(F.size("words")).distinct().where(F.size("words") < WINDOW).collect())


def contamination(docs: DataFrame, items: DataFrame, printed: DataFrame, short: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, spans, item_ids`` of each document that has hits; spans are (start, end) in words, disjoint, end exclusive.

    ``items`` and ``short`` are of ``item_texts`` and ``short_lengths``, ``printed`` the ``fingerprints`` of ``docs``.
    """
    length = F.least(F.size("words"), F.lit(WINDOW))
    prints = F.when(F.size("words") >= WINDOW, _winnow(F.col("words")))
    for k in short:
        prints = F.when(F.size("words") == k, _places(F.col("words"), k)).otherwise(prints)
    item_prints = items.select(F.explode(prints).alias("v"), length.alias("n")).select(F.shiftright("v", PLACE_BITS).alias("print"), "n").distinct()
    item_prints = common.broadcast_if_small(common.checkpoint(item_prints), 16)
    hits = (
        printed.select("doc_id", "text_hash", F.explode("prints").alias("v"))
        .withColumn("print", F.shiftright("v", PLACE_BITS))
        .join(item_prints, "print")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct(F.col("v").bitwiseAND((1 << PLACE_BITS) - 1).cast("int").alias("at"), "n")).alias("hits"))
    )
    hits = common.broadcast_if_small(common.checkpoint(hits), 32 + 16 * F.size("hits"))
    # Extension: each hit lies in at most SPAN windows of its length; compare their words.
    # A short text can meet a long item's print through the hashes kept for short items, but has no window.
    around = lambda h, n: F.when(h["n"] < WINDOW, F.array(h["at"])).when(n >= WINDOW, F.sequence(F.greatest(h["at"] - (SPAN - 1), F.lit(0)), F.least(h["at"], n - WINDOW))).otherwise(F.array().cast("array<int>"))
    spans = lambda w, hs: F.array_distinct(F.flatten(F.transform(hs, lambda h: F.transform(around(h, F.size(w)), lambda i: F.struct(i.alias("at"), h["n"].alias("n"), _run(w, i, h["n"]).alias("window"))))))
    # Equal rows share one result.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    near = common.join_rows(rows, hits).select("doc_id", "text_hash", F.explode(let(tokens(F.col("text")), lambda w: spans(w, F.col("hits")))).alias("s")).select("doc_id", "text_hash", "s.*")
    windows, sets = item_windows(items)
    windows = common.broadcast_if_small(common.checkpoint(windows), 88 + F.length("window"))
    true = common.checkpoint(near.join(windows, "window").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("at", "n")).alias("at"), F.collect_set("set_id").alias("sets")))
    # An id may stand in several of the sets: each counts once.
    named = true.select("doc_id", "text_hash", F.explode("sets").alias("set_id")).join(sets, "set_id").select("doc_id", "text_hash", "item").distinct()
    named = named.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    merged = true.select("doc_id", "text_hash", _union(F.col("at")).alias("spans"))
    # Items without an id leave their spans.
    return common.join_rows(merged, named, "left").withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))


def _union(at: Column) -> Column:
    """Disjoint (start, end) from sorted (at, n): a new one begins beyond the furthest end so far."""
    kind = "struct<done:array<struct<start:int,end:int>>,start:int,end:int>"
    empty = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end")).cast(kind)

    def step(a: Column, x: Column) -> Column:
        end = x["at"] + x["n"]
        closed = F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end"))))
        fresh = x["at"] > a["end"]
        return F.when(fresh, F.struct(F.when(a["start"] < 0, a["done"]).otherwise(closed).alias("done"), x["at"].alias("start"), end.alias("end")).cast(kind)).otherwise(F.struct(a["done"].alias("done"), a["start"].alias("start"), F.greatest(a["end"], end).alias("end")).cast(kind))

    return F.aggregate(F.array_sort(at), empty, step, lambda a: F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end")))))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without hits, as they are."""
    items = common.checkpoint(item_texts(benchmark))
    short = short_lengths(items)
    found = contamination(docs, items, fingerprints(docs, short, id_col, text_col), short, id_col, text_col)
    found = common.checkpoint(found.select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash")))
    found = common.broadcast_if_small(found, 24)
    return docs.join(found, docs[id_col].eqNullSafe(found["_doc_id"]) & (F.xxhash64(docs[text_col]) == found["_text_hash"]), "left_anti")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, hit words, items, and whether it is contaminated."""
    items = common.checkpoint(item_texts(benchmark))
    short = short_lengths(items)
    # Texts are cut into words once; the words of the few that have hits once more.
    printed = common.checkpoint(fingerprints(docs, short, id_col, text_col))
    found = contamination(docs, items, printed, short, id_col, text_col)
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0), lambda t, s: t + s["end"] - s["start"]), F.lit(0)).cast("long")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    found = common.broadcast_if_small(common.checkpoint(found), 64 + 8 * F.size("spans") + F.length(F.array_join("item_ids", ",")))
    return common.join_rows(printed.select("doc_id", "text_hash", "n_words"), found, "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
