"""Substring deduplication behind a count-min prefilter.

A window is ``WINDOW`` consecutive words of one document. A word goes if a window that
covers it also starts in a document of smaller id.

1. Each document gets a digest of all its words and its *anchors*: of the ``GRAM``-word
   hashes inside a window the least is the window's anchor, so equal windows have equal
   anchors, and a text has about one anchor for every twenty words. Documents of the same words
   are copies: all but the least id lose every window outright.
2. The anchors of the remaining documents (a document counts an anchor once) are counted by a count-min sketch in
   blocks of cells; both cells of an anchor lie in its block. Each partition sends its sketch block by block, and its distinct
   anchors behind; the task of a block adds the partition sketches up, counts saturating at two, and then tests the
   anchors against them. An estimate is never below the number of documents that hold the anchor, which is never below that of
   documents that hold the window: no repeated window is lost.
3. A second pass emits only windows whose anchor is estimated at two or more documents, groups them
   exactly by a 128-bit digest (two polynomials over two independent word hashes), and keeps those of documents above a window's least id.

The estimated anchors reach the second pass as bits (16 for each) if they take at most ``MOST_BITS`` on a
worker, as measured, and else by a join of each document with its own; the sketch and its estimates are the same at every size.

Defined cases: null text has no words; texts below WINDOW words lose nothing; a null id is
never smaller or larger than another, so it neither removes nor loses words; rows of equal
id don't remove each other's words; texts of any length are taken whole; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import SECOND_HASH, WORD_HASH, gram_hashes

WINDOW, GRAM = 50, 10
#: Count-min rows, cells of a block's row, cells of a row for each key, keys a partition sketches at a time.
ROWS, BLOCK, SPARE, CHUNK = 2, 1 << 16, 8, 1 << 21
#: Bits that a worker of the second pass holds at most.
MOST_BITS = 1 << 29
SECOND_BASE = 0xD1B54A32D192ED03
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def anchors(words: np.ndarray) -> np.ndarray:
    """The anchor of each window, in order."""
    grams = gram_hashes(words, GRAM)
    span = WINDOW - GRAM + 1
    out = []
    for at in range(0, len(grams) - span + 1, 1 << 15):
        part = grams[at : at + (1 << 15) + span - 1]
        least, width = part, 1  # doubling: minima of 1, 2, 4, ... consecutive hashes
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        n = len(part) - span + 1
        out.append(np.minimum(least[:n], least[span - width : span - width + n]))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def cells(keys: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each key in each row of ``width`` cells: all in the block that the first row's hash chooses."""
    hashes = [common.mix(keys ^ np.uint64(seed)) for seed in _SEEDS[:ROWS]]
    block = (hashes[0] >> np.uint64(16)) & np.uint64(width // BLOCK - 1)
    return [(block << np.uint64(16) | (h & np.uint64(BLOCK - 1))).astype(np.int64) for h in hashes]


def _words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))


def profile(rows: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_words, digest, anchors`` of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, found = [], [], []
            for text in batch.column(2).to_pylist():
                w = _words(text)
                n.append(len(w))
                digest.append(_digest(w))
                found.append(np.unique(anchors(WORD_HASH.of(w))).view(np.int64) if len(w) >= WINDOW else np.empty(0, np.int64))
            ends = np.zeros(len(n) + 1, np.int32)
            np.cumsum([len(x) for x in found], out=ends[1:])
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists], ["doc_id", "text_hash", "n_words", "digest", "anchors"])

    return rows.mapInArrow(run, "doc_id long, text_hash long, n_words long, digest binary, anchors array<long>")


def width_for(keys: int) -> int:
    """Cells of a row for so many keys: a power of two, SPARE a key or more."""
    return max(BLOCK, 1 << max(SPARE * keys - 1, 0).bit_length())


def _by_block(at: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Blocks of sorted cells, and where they stand."""
    if len(at):
        cut = np.flatnonzero(np.diff(at >> 16)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
            yield int(at[a]) >> 16, slice(a, b)


def estimated(lists: DataFrame, width: int, least: int = 2) -> DataFrame:
    """``block, anchors``: the keys of a column of distinct lists whose estimate by the merged sketch is ``least`` or more, each once.

    The rows of a block's task are sorted: first the partitions' sketches of it, which it adds up, then their keys.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            kept.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            size += len(kept[-1])
            if size >= CHUNK:
                yield from _sketched(np.concatenate(kept), width)
                kept, size = [], 0
        if size:
            yield from _sketched(np.concatenate(kept), width)

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, passed = None, None, np.empty(0, np.uint64)
        for batch in batches:
            for block, row, at, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    if len(passed):
                        yield _keys(now, passed)
                    now, counts, passed = block, np.zeros((ROWS, BLOCK), np.uint8), np.empty(0, np.uint64)
                if row < ROWS:
                    at = np.frombuffer(at, np.uint16)
                    counts[row, at] = np.minimum(counts[row, at] + np.frombuffer(data, np.uint8), 2)
                else:
                    keys = np.frombuffer(data, np.uint64)
                    found = np.minimum.reduce([counts[r, c & (BLOCK - 1)] for r, c in enumerate(cells(keys, width))])
                    passed = np.union1d(passed, keys[found >= least])
        if len(passed):
            yield _keys(now, passed)

    sent = lists.mapInArrow(partial, "block int, row int, cells binary, data binary")
    return sent.repartition("block").sortWithinPartitions("block", "row").mapInArrow(tested, "block int, anchors array<long>")


def _keys(block: int, keys: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), pa.array(keys.view(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), lists], ["block", "anchors"])


def _sketched(keys: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """The touched cells of each block with their counts, saturating at 2, row by row; then the block's distinct keys."""
    out: list[tuple] = []
    distinct = np.unique(keys)
    for r, (every, own) in enumerate(zip(cells(keys, width), cells(distinct, width), strict=True)):
        at, n = np.unique(every, return_counts=True)
        n = np.minimum(n, 2).astype(np.uint8)
        out += [(b, r, (at[part] & (BLOCK - 1)).astype(np.uint16).tobytes(), n[part].tobytes()) for b, part in _by_block(at)]
        if r == 0:
            order = np.argsort(own, kind="stable")
            out += [(b, ROWS, b"", distinct[order[part]].tobytes()) for b, part in _by_block(own[order])]
    for i in range(0, len(out), 4096):
        columns = zip(*out[i : i + 4096], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "row", "cells", "data"])


def cells_of(keys: DataFrame, width: int) -> DataFrame:
    """``row, block, cells``: two bytes for each cell of the keys of ``block, anchors``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [np.unique(c) for c in cells(batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64), width)]
            out = [(r, b, (every[part] & (BLOCK - 1)).astype(np.uint16).tobytes()) for r, every in enumerate(at) for b, part in _by_block(every)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["row", "block", "cells"])

    return keys.select("anchors").mapInArrow(run, "row int, block int, cells binary")


class Estimates:
    """Which keys the sketch puts at two or more: a bit for each of their cells."""

    def __init__(self, touched, width: int):
        self.width = width
        self.bits = np.zeros((ROWS, width // 8), np.uint8)
        for r, b, at in touched:
            block = self.bits[r, b * BLOCK // 8 : (b + 1) * BLOCK // 8]
            some = np.unpackbits(block)
            some[np.frombuffer(at, np.uint16)] = 1
            block[:] = np.packbits(some)

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for r, c in enumerate(cells(keys, self.width)):
            out &= (self.bits[r, c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 > 0
        return out


def own_anchors(about: DataFrame, repeated: DataFrame) -> DataFrame:
    """``doc_id, text_hash, hot``: of each document, its anchors among ``block, anchors``."""
    held = about.select("doc_id", "text_hash", F.explode("anchors").alias("anchor")).join(repeated.select(F.explode("anchors").alias("anchor")), "anchor")
    return held.groupBy("doc_id", "text_hash").agg(F.collect_set("anchor").alias("hot"))


def suspects(rows: DataFrame, estimates: Estimates | None) -> DataFrame:
    """``h1, h2, doc_id, text_hash, at`` of each window estimated in two documents or more: by bits, or by the column ``hot``.

    Among a batch's documents of the same words only the least id is sent: the others are copies.
    """
    model = rows.sparkSession.sparkContext.broadcast(estimates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            first: dict[bytes, tuple[int, int, list[bytes], list[int]]] = {}
            for doc, th, text, *hot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = _words(text)
                if doc is not None and len(w) >= WINDOW:
                    d = _digest(w)
                    if d not in first or doc < first[d][0]:
                        first[d] = doc, th, w, hot
            out = [[] for _ in range(5)]
            for doc, th, w, hot in first.values():
                h = WORD_HASH.of(w)
                keys, back = np.unique(anchors(h), return_inverse=True)
                passed = known.repeated(keys) if known else np.isin(keys, np.array(hot[0], np.int64).view(np.uint64))
                at = np.flatnonzero(passed[back])
                if len(at):
                    other = SECOND_HASH.of(w)
                    for x, y in zip(out, (gram_hashes(h, WINDOW)[at].view(np.int64), gram_hashes(other, WINDOW, SECOND_BASE)[at].view(np.int64), np.full(len(at), doc), np.full(len(at), th), at.astype(np.int32)), strict=True):
                        x.append(y)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["h1", "h2", "doc_id", "text_hash", "at"])

    return rows.mapInArrow(run, "h1 long, h2 long, doc_id long, text_hash long, at int")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, spans``: the (start, end) words to remove, end exclusive, of each document that loses some."""
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = _keyed(docs, id_col, text_col)
    about = common.checkpoint(profile(rows))
    known = about.where(f"doc_id IS NOT NULL AND n_words >= {WINDOW}")
    leaders = known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.first("anchors").alias("anchors"))
    leaders = common.checkpoint(leaders)
    total = leaders.select(F.sum(F.size("anchors"))).first()[0] or 0
    repeated = common.checkpoint(estimated(leaders.select("anchors"), width_for(total)))
    width = width_for(repeated.select(F.sum(F.size("anchors"))).first()[0] or 0)
    if ROWS * width <= MOST_BITS:
        # Two bytes a cell, so at most MOST_BITS / SPARE * 2 bytes, come back.
        found = suspects(rows, Estimates(cells_of(repeated, width).collect(), width))
    else:
        found = suspects(common.join_rows(rows, own_anchors(known, repeated)), None)
    found = common.checkpoint(found)
    first = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h1", "h2", "first")
    windows = found.join(common.checkpoint(first), ["h1", "h2"]).where("doc_id > first").select("doc_id", "text_hash", "at")
    spans = windows.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("at")).alias("at"))
    gap = lambda a, b: F.coalesce(b - a > WINDOW, F.lit(True))
    starts = lambda p: F.filter(p, lambda x, i: gap(F.get(p, i - 1), x))
    ends = lambda p: F.transform(F.filter(p, lambda x, i: gap(x, F.get(p, i + 1))), lambda x: x + WINDOW)
    spans = spans.select("doc_id", "text_hash", common.let(F.col("at"), lambda p: F.zip_with(starts(p), ends(p), lambda a, b: F.struct(a.alias("start"), b.alias("end")))).alias("spans"))
    # Copies lose all their words; what the exact pass says of them is part of that.
    copies = known.join(leaders.where("first < last").select("digest", "first"), "digest").where("doc_id > first").select("doc_id", "text_hash", F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))).alias("spans"))
    covered = F.aggregate("spans", F.lit(0), lambda t, s: t + s["end"] - s["start"])
    return copies.unionByName(spans).groupBy("doc_id", "text_hash").agg(F.max_by("spans", covered).alias("spans"))


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every document; ``kept`` is the remaining words joined by a blank."""
    rows = _keyed(docs, id_col, text_col)
    gone = common.checkpoint(repeats(docs, id_col, text_col))
    gone = common.broadcast_if_small(gone, 40 + 8 * F.size("spans"))
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lost, kept = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                w = _words(text)
                n.append(len(w))
                for s in reversed(spans or ()):
                    del w[s["start"] : s["end"]]
                lost.append(n[-1] - len(w))
                kept.append(b" ".join(w).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return common.join_rows(rows, gone, "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op4_substrings(spark, sf_dir: str) -> DataFrame:
    return dedupe(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
