"""N-gram Jaccard join: a MinHash LSH forest proposes, exact comparison disposes.

A document is the set of its ``SHINGLE``-word runs (a shorter text with words is one run).
Two documents are linked if their sets have a Jaccard similarity of ``SIMILAR`` or more.

1. Documents of equal sets are copies: one node, whose representative stands for all.
2. Each node has a label of ``DEPTH`` min-hashes in each of ``TREES`` prefix tries. Nodes that share the first x
   min-hashes of a tree lie below one trie node of depth x; they meet there. Two sets of similarity s
   meet somewhere at depth x with probability ``1 - (1 - s**x)**TREES``.
3. Descent: groups that share full labels are compared exactly. The similarities of the links found, each weighted
   by the inverse of its chance to be found, estimate those of all links, together with a share ``PRIOR`` of links
   right at the threshold. The matched prefix is then shortened, min-hash by min-hash, until the
   estimated share of links found is ``RECALL``.
4. Ascent: groups that share a prefix of that length are compared; pairs that have met before are left out.
5. Classes are the connected components of the links.

A pair that meets in several trees counts in the first of them alone, and a group all of whose nodes meet
in an earlier tree isn't compared at all. A large group is cut by set size (similar sets have similar
sizes) and by hash into blocks; each pair of blocks that can hold a link is one task. A task sends each
node's number of links, and a spanning forest of the links; no pair leaves it. Trie nodes are counted by partial
aggregates, never collected.

Defined cases: null or wordless texts have no runs, so no links, and are classes of their own; a null id takes
part like any other and is never the least of a class unless all its ids are null; rows of equal id are
rows of their own, by their texts: the classes of two texts of one id may differ (and then share a
``class_id`` if it is the least in both, but not a ``class_key``); an empty table gives an empty table; very
long texts are taken whole; only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.iterate import stars

from . import common
from .common import WORD_HASH, gram_hashes, mix

SHINGLE, SIMILAR = 5, (4, 5)
TREES, DEPTH, RECALL, PRIOR = 24, 8, 0.9999, 0.01
#: Documents, and shingles, of a block; columns of an incidence matrix at a time.
BLOCK_DOCS, BLOCK_SHINGLES, COLUMNS = 512, 1 << 19, 2048
#: Sets of sizes a and b are linked only if neither is more than 5/4 of the other; the rest is for rounding.
SIZE_CLASS = SIMILAR[1] / SIMILAR[0] + 0.01
#: Links are told apart by hundredths of similarity.
BANDS = 100
_MULTIPLIERS = (mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def found_at(similarity: float, depth: int, trees: int = TREES) -> float:
    """The chance that two sets of this similarity meet at this depth of some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_length(links: dict[int, int], recall: float = RECALL, prior: float = PRIOR) -> int:
    """The longest prefix that is estimated to find the share ``recall`` of all links; 1 if none does.

    ``links`` counts, by hundredths of similarity, the links that full labels have found.
    """
    weight = {band / BANDS: n / found_at(band / BANDS, DEPTH) for band, n in links.items()}
    least = SIMILAR[0] / SIMILAR[1]
    weight[least] = weight.get(least, 0) + max(1.0, prior * sum(weight.values()))
    depth = DEPTH
    while depth > 1 and sum(w * found_at(s, depth) for s, w in weight.items()) < recall * sum(weight.values()):
        depth -= 1
    return depth


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``SHINGLE`` words."""
    words = text.encode().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(WORD_HASH.of(words), min(SHINGLE, len(words))))


def _key(runs: bytes) -> bytes | None:
    """Digest of a shingle set; None for the empty one."""
    return hashlib.blake2b(runs, digest_size=16).digest() if runs else None


def labels(runs: np.ndarray) -> bytes:
    """Two bytes of each min-hash, tree by tree."""
    least, h = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32), (runs >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), 1024):
        # An odd multiplier permutes the hashes; its least product is one min-hash.
        np.minimum(least, (h[None, at : at + 1024] * _MULTIPLIERS[:, None]).min(axis=1), out=least)
    return least.astype("<u2").tobytes()


def profile(rows: DataFrame) -> DataFrame:
    """``doc_id, text_hash, set_key, n, labels``: the digest and size of each shingle set, and its tree labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("jaccard")
        for batch in batches:
            keys, n, found = [], [], []
            for text in batch.column(2).to_pylist():
                runs = shingles(text)
                keys.append(_key(runs.tobytes()))
                n.append(len(runs))
                found.append(labels(runs) if len(runs) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "text_hash", "set_key", "n", "labels"])
        common.rest()

    return rows.mapInArrow(run, "doc_id long, text_hash long, set_key binary, n long, labels binary")


def _prefix(tree: int, depth: int) -> Column:
    """Key of the trie node of a label's first ``depth`` min-hashes."""
    return F.xxhash64(F.lit(tree), F.substring("labels", 2 * DEPTH * tree + 1, 2 * depth))


def groups(sets: DataFrame, depth: int, after: int | None = None) -> DataFrame:
    """``node, tree, key, class, block, own, above, below, bins``: the members of each group to compare at ``depth``.

    Groups below a trie node of two members or more, less those whose members all meet in an earlier tree, or met
    at the depth ``after``. A small group is one block (``own`` 0). A large one has blocks of each size
    class: so many in the member's class, the one above and the one below.
    """
    each = sets.select("node", "n", F.posexplode(F.array(*(_prefix(t, depth) for t in range(TREES)))).alias("tree", "key"))
    shared = common.broadcast_if_small(common.checkpoint(each.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")), 16)
    met = common.checkpoint(each.join(shared, "key"))
    about = met.join(sets.select("node", "labels"), "node")
    seen = [F.when(F.col("tree") > t, _prefix(t, depth)) for t in range(TREES - 1)] + [_prefix(t, after) for t in range(TREES if after else 0)]
    ends = [f(x).alias(f"{name}{k}") for k, x in enumerate(seen) for name, f in (("low", F.min), ("high", F.max))]
    all_met = F.lit(False)
    for k in range(len(seen)):
        all_met = all_met | F.coalesce(F.col(f"low{k}") == F.col(f"high{k}"), F.lit(False))
    open_ = about.groupBy("key").agg(*ends).where(~all_met).select("key")
    met = met.join(common.broadcast_if_small(common.checkpoint(open_), 16), "key").withColumn("class", F.floor(F.log("n") / F.log(F.lit(SIZE_CLASS))).cast("int"))
    met = common.checkpoint(met)
    bins = 12 + (met.agg(F.sum("n")).first()[0] or 0) // (BLOCK_SHINGLES // 2)

    cells = met.groupBy("key", "class").agg(F.count("*").alias("docs"), F.sum("n").alias("runs"))
    whole = cells.groupBy("key").agg(F.sum("docs").alias("docs"), F.sum("runs").alias("runs")).where((F.col("docs") > BLOCK_DOCS) | (F.col("runs") > BLOCK_SHINGLES)).select("key")
    cut = common.checkpoint(cells.join(whole, "key").select("key", "class", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("runs") / BLOCK_SHINGLES)).cast("int").alias("own")))
    near = lambda step, name: cut.select("key", (F.col("class") + step).alias("class"), F.col("own").alias(name))
    cut = cut.join(near(-1, "above"), ["key", "class"], "left").join(near(1, "below"), ["key", "class"], "left")
    cut = common.broadcast_if_small(common.checkpoint(cut.fillna(0)), 40)
    placed = met.join(cut, ["key", "class"], "left").fillna(0, ["own", "above", "below"])
    block = F.when(F.col("own") > 0, F.pmod(F.xxhash64("node"), F.col("own"))).otherwise(0).cast("int")
    return placed.select("node", "tree", "key", "class", block.alias("block"), "own", "above", "below", F.lit(bins).cast("long").alias("bins"))


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairwise intersections. Runs in one set only don't count, so they get no column."""
    runs = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(runs, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = number[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        out += part @ part.T
    return out


def compare(sets: list[np.ndarray], skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which pairs are linked: (i, j) arrays, i < j, and their similarity in hundredths; pairs of the matrix ``skip`` don't count."""
    size = np.array([len(x) for x in sets], np.int32)
    shared = _intersections(sets).astype(np.int32)
    p, q = SIMILAR
    union = size[:, None] + size[None, :] - shared
    i, j = np.nonzero(np.triu((q * shared >= p * union) & ~skip, 1))
    return i, j, BANDS * shared[i, j] // union[i, j]


def met_before(prefixes: np.ndarray, depth: int, trees: range) -> np.ndarray:
    """Which pairs share the first ``depth`` min-hashes of one of the trees."""
    # A label of eight two-byte min-hashes is two words; a mask leaves the prefix.
    mask = np.zeros(DEPTH, "<u2")
    mask[:depth] = 0xFFFF
    out = np.zeros((len(prefixes), len(prefixes)), bool)
    words = prefixes.view("<u8") & mask.view("<u8")
    for t in trees:
        same = np.ones_like(out)
        for x in words[:, t].T:
            same &= x[:, None] == x[None, :]
        out |= same
    return out


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index of each index's component."""
    root = np.arange(n)
    while len(i):
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return root


def links(rows: DataFrame, sets: DataFrame, members: DataFrame, depth: int, after: int | None, twice: bool) -> DataFrame:
    """``id, n_links, root``, a row for each task a linked node was in; rows without an id count links by similarity (``root``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("jaccard")
        for batch in batches:
            runs = [shingles(t).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.binary()), *batch.columns[1:]], ["runs", "node", "labels"])
        common.rest()

    def one(table: pa.Table) -> pa.Table:
        common.begin("jaccard")
        ids, tree, key, first = (table.column(c).to_numpy() for c in ("node", "tree", "key", "first"))
        runs, label = (table.column(c).to_pylist() for c in ("runs", "labels"))
        order = np.lexsort((ids, key))
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        found, bands = [(np.empty(0, np.int64),) * 3], np.zeros(BANDS + 1, np.int64)
        for part in np.split(order, cuts):
            own = np.frombuffer(b"".join(label[k] for k in part), "<u2").reshape(len(part), TREES, DEPTH)
            skip = met_before(own, depth, range(tree[part[0]]))
            if after:
                skip |= met_before(own, after, range(TREES))
            if not first[part].all():
                skip |= first[part][:, None] == first[part][None, :]
            if skip[np.triu_indices(len(part), 1)].all():
                continue
            i, j, similarity = compare([np.frombuffer(runs[k], np.uint64) for k in part], skip)
            if len(i):
                degree = np.bincount(np.concatenate([i, j]), minlength=len(part))
                some = np.flatnonzero(degree)
                found.append((ids[part][some], degree[some], ids[part][forest(len(part), i, j)][some]))
                bands += np.bincount(similarity, minlength=BANDS + 1)
        some = np.flatnonzero(bands)
        nodes, degrees, roots = (np.concatenate(x) for x in zip(*found, strict=True))
        named = pa.concat_arrays([pa.array(nodes, pa.int64()), pa.nulls(len(some), pa.int64())])
        return pa.table([named, pa.array(np.concatenate([degrees, bands[some]])), pa.array(np.concatenate([roots, some]))], ["id", "n_links", "root"])

    nodes = members.select("node").distinct().join(sets, "node").select("node", "labels", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_hash").alias("text_hash"))
    nodes = common.broadcast_if_small(common.checkpoint(nodes), 48 + 2 * TREES * DEPTH)
    texts = common.join_rows(rows, nodes).select("text", "node", "labels")
    runs = texts.mapInArrow(run, "runs binary, node long, labels binary")
    if twice:  # rows equal in id and text
        runs = runs.groupBy("node").agg(F.first("runs").alias("runs"), F.first("labels").alias("labels"))
    # Small groups share a bin; a member of a cut group goes to each pair of blocks that it is part of.
    there = F.struct(F.col("class").alias("c"), F.col("block").alias("b"))
    cell = lambda c, b: F.struct(c.alias("c"), b.alias("b"))
    others = lambda n, c: F.transform(F.filter(F.sequence(F.lit(0), n), lambda b: b < n), lambda b: cell(c, b))
    partners = F.concat(others(F.col("own"), F.col("class")), others(F.col("above"), F.col("class") + 1), others(F.col("below"), F.col("class") - 1))
    dealt = members.withColumn("other", F.explode(F.when(F.col("own") == 0, F.array(there)).otherwise(partners)))
    low, high = F.least(there, "other"), F.greatest(there, "other")
    task = F.when(F.col("own") == 0, F.pmod(F.xxhash64("key"), "bins")).otherwise(F.xxhash64("key", low, high))
    dealt = dealt.select("node", "tree", "key", (F.col("own") == 0).alias("whole"), task.alias("task"), (there == low).alias("first"))
    dealt = common.checkpoint(dealt)
    kind = "id long, n_links long, root long"
    joined = runs.join(common.broadcast_if_small(dealt, 48), "node")
    return joined.groupBy("task", "whole").applyInArrow(one, kind)


def _compared(rows: DataFrame, sets: DataFrame, depth: int, after: int | None, twice: bool) -> DataFrame:
    return common.checkpoint(links(rows, sets, common.checkpoint(groups(sets, depth, after)), depth, after, twice))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_hash, set_key`` of every row, and ``set_key, lead, class_key, n_links, n_copies`` of every set.

    ``lead`` is the least (doc_id, text_hash) of the class, null ids last.
    """
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    about = common.checkpoint(profile(rows))
    with_words = about.where("set_key IS NOT NULL")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("rep")
    sets = with_words.groupBy("set_key").agg(least, (F.count("*") - 1).alias("n_copies"), F.first("n").alias("n"), F.first("labels").alias("labels"))
    sets = common.checkpoint(sets.withColumn("node", F.monotonically_increasing_id()))
    twice = not with_words.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").isEmpty()

    deep = _compared(rows, sets, DEPTH, None, twice)
    depth = prefix_length({r.root: r.n for r in deep.where("id IS NULL").groupBy("root").agg(F.sum("n_links").alias("n")).collect()})
    found = deep.where("id IS NOT NULL")
    if depth < DEPTH:
        found = found.unionByName(_compared(rows, sets, depth, DEPTH, twice).where("id IS NOT NULL"))
    degree = found.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    star = stars(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    root = star.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(star.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()
    linked = sets.select(F.col("node").alias("id"), "set_key", "rep", "n_copies").join(degree, "id", "left").join(root, "id", "left")
    linked = common.checkpoint(linked.select("set_key", "rep", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "id").alias("root")))
    # Classes of one set lead themselves; a large class meets its leader through a broadcast row, if these fit.
    lead = linked.groupBy("root").agg(F.min("rep").alias("lead"), F.min("set_key").alias("class_key"), F.count("*").alias("sets")).where("sets > 1").drop("sets")
    led = linked.join(common.broadcast_if_small(common.checkpoint(lead), 72), "root", "left")
    led = led.select("set_key", F.coalesce("lead", "rep").alias("lead"), F.coalesce("class_key", "set_key").alias("class_key"), "n_links", "n_copies")
    return about.select("doc_id", "text_hash", "set_key"), led


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, n_links, n_copies, class_key`` of every row.

    ``class_id`` is the least id that links lead to; ``n_links`` counts the other distinct
    shingle sets linked to this one; ``n_copies`` the other rows of the same set; ``class_key`` tells classes
    apart where ids repeat (null without words).
    """
    about, sets = classes(docs, id_col, text_col)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    own = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("lead.doc_id"))
    classed = about.join(sets, "set_key", "left")
    return classed.select("doc_id", own.alias("class_id"), zero("n_links"), zero("n_copies"), F.lower(F.hex("class_key")).alias("class_key"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, as it is: that of the least id (nulls last), then text hash, then JSON form. Wordless rows all stay."""
    about, sets = classes(docs, id_col, text_col)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    classed = common.checkpoint(about.join(sets, "set_key").select("doc_id", "text_hash", (own == F.col("lead")).alias("leads")))
    counted = classed.groupBy("doc_id", "text_hash", "leads").agg(F.count("*").alias("n")).where("NOT leads OR n > 1")
    keys = lambda df: df.select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"))
    counted = common.checkpoint(counted)
    same = lambda df: docs[id_col].cast("long").eqNullSafe(df["_doc_id"]) & (F.xxhash64(docs[text_col]) == df["_text_hash"])
    gone = common.broadcast_if_small(keys(counted), 32)
    kept = docs.join(gone, same(gone), "left_anti")
    again = keys(counted.where("leads"))
    if again.isEmpty():
        return kept
    # Equal in id and text: one row each.
    again = common.broadcast_if_small(again, 32)
    again = docs.join(again, same(again), "left_semi")
    row = F.struct(*(F.col(c) for c in docs.columns))
    one = again.groupBy(id_col, F.xxhash64(text_col)).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return kept.unionByName(one)


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents")).drop("class_key")
