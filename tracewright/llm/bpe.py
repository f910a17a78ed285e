"""Byte-level BPE encoding and decoding.

A text is cut by the tokenizer's pattern; each piece is merged on its own. Over the
byte positions of a piece lies a segment tree of fan-out ``FAN`` whose leaves hold the rank of
the pair that starts there and whose inner nodes hold the least (rank, position) below, so the
root is the leftmost pair of minimum rank. A merge updates three leaves (the merged part,
the part it swallowed and its live left neighbour) and their paths, each in O(log n).

Defined cases: null text encodes to no ids; ``doc_id`` may be null or repeated, rows are
independent; only the id and text columns are read, so other columns can't clash; an
empty table gives an empty table; a piece of n bytes takes O(n log n).
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Children of an inner node of the segment tree.
FAN = 16
#: Chunks, and pieces, that a worker remembers (twice that at most); longer ones aren't kept.
CACHE_ENTRIES, CACHE_PIECE = 170_000, 40
_LOADED: dict[str, tuple[dict[bytes, int], list[bytes]]] = {}


def load(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    """Ranks by token bytes, and token bytes by rank; read once a process."""
    if path not in _LOADED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        _LOADED[path] = ranks, tokens
    return _LOADED[path]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    bits = n.bit_length()
    mask, none = (1 << bits) - 1, 1 << 62
    leaves = [none if (rank := get(piece[i : i + 2])) is None else rank << bits | i for i in range(n - 1)]
    leaves.append(none)
    # Inner levels up to the one with the root's children; a short piece has leaves and root alone.
    levels = [leaves]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    top = levels[-1]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (least := min(top)) < none:
        i = least & mask
        j = after[i]
        after[i] = end = after[j]
        # Leaves: the one swallowed, the merged part, the live left neighbour.
        leaves[j] = none
        if end < n:
            before[end] = i
            leaves[i] = none if (rank := get(piece[i : after[end]])) is None else rank << bits | i
        else:
            leaves[i] = none
        if (p := before[i]) >= 0:
            leaves[p] = none if (rank := get(piece[p:end])) is None else rank << bits | p
        else:
            p = i
        # Their paths to the root, which soon meet.
        below = leaves
        for level in levels[1:]:
            p, i, j = p // FAN, i // FAN, j // FAN
            for at in {p, i, j}:
                level[at] = min(below[at * FAN : at * FAN + FAN])
            below = level
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Recent(dict):
    """Remembers about twice ``limit`` values of ``make``: two generations, of which the older goes."""

    def __init__(self, make, limit: int, longest: int):
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Ids of whole texts.

    The usual pattern never joins what lies on either side of a lone blank between two other
    characters, so a text falls into chunks at such blanks; with another pattern it is one chunk. Chunks and their pieces are
    remembered up to a bound, their ids as the bytes of 32-bit integers.
    """

    CHUNK = re.compile(r"(?:\s*\S+|\s+)(?:(?! \S)\s+\S*)*")

    def __init__(self, path: str, pattern: str):
        ranks, split = load(path)[0], regex.compile(pattern).findall
        self.pieces = Recent(lambda piece: array("i", merge(piece.encode(), ranks)).tobytes(), CACHE_ENTRIES, CACHE_PIECE)
        self.cut = self.CHUNK.findall if pattern == public_tokenizers.PATTERN else lambda text: [text]
        self.chunks = Recent(lambda chunk: b"".join(map(self.pieces.__getitem__, split(chunk))), CACHE_ENTRIES, CACHE_PIECE)

    def __call__(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, self.cut(text))), np.int32)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _forget() -> None:
    _ENCODERS.clear()
    _LOADED.clear()


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    common.begin("bpe", _forget)
    coder = _ENCODERS.get((path, pattern)) or _ENCODERS.setdefault((path, pattern), Encoder(path, pattern))
    for batch in batches:
        ids = [coder(t or "") for t in batch.column(1).to_pylist()]
        ends = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=ends[1:])
        flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    common.begin("bpe", _forget)
    token = load(path)[1].__getitem__
    for batch in batches:
        column = batch.column(1)
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets) - column.offsets[0].as_py() if len(column) else []
        out = [b"".join(map(token, flat[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` of each row's whole text."""
    path = path or public_tokenizers.path(VOCABULARY)
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    return rows.mapInArrow(lambda batches: _encoded(batches, path, pattern), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``decoded binary``, the bytes that ``ids`` stand for, to ``doc_id, ids``."""
    path = path or public_tokenizers.path(VOCABULARY)
    common.small_batches(coded.sparkSession)
    rows = coded.select("doc_id", "ids")

    return rows.mapInArrow(lambda batches: _decoded(batches, path), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


def _both(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded`` of each row: ``decode(encode(docs))`` in one worker."""
    path = path or public_tokenizers.path(VOCABULARY)
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(_encoded(batches, path, pattern), path)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


def digests(docs: DataFrame, **options) -> DataFrame:
    """One row per document: the count and digests of its ids and of the bytes they decode to."""
    return _both(docs, **options).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def tokenised(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256``: the ids themselves."""
    return _both(docs, **options).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
