"""Pieces shared by the corpus operators: table access, native expression helpers, checkpoints and hashing."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.iterate import checkpoint  # noqa: F401

#: ASCII white space, as a Java character class body. ``bytes.split()`` splits on the same bytes.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of an Arrow batch: at 4 KB a text that is 2 MB; a few very long texts still fit.
BATCH_ROWS = 512
#: Bytes up to which a measured table is broadcast; beyond it a shuffle join takes its place.
BROADCAST_BYTES = 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, and let workers look for this package where the driver found it (a cluster gets it by --py-files)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (env.get("PYTHONPATH"), root)))
    # A worker has one core; its matrix products shouldn't start a thread for each of the machine's.
    env.setdefault("OMP_NUM_THREADS", "1")
    env.setdefault("OPENBLAS_NUM_THREADS", "1")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once a row, however often ``use`` mentions it in lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    """Words between ASCII white space; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone. All-ASCII texts take the byte-wise ``lower``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def broadcast_if_small(df: DataFrame, row_bytes: Column | int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (already checkpointed) with a broadcast hint if its measured bytes are within ``limit``."""
    size = df.select(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes).cast("long")).first()[0] or 0
    return F.broadcast(df) if size <= limit else df.hint("merge")


def join_rows(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joins on ``doc_id`` (null equals null) and ``text_hash``; keeps the left keys."""
    right = right.withColumnsRenamed({"doc_id": "_doc_id", "text_hash": "_text_hash"})
    return left.join(right, left["doc_id"].eqNullSafe(right["_doc_id"]) & (left["text_hash"] == right["_text_hash"]), how).drop("_doc_id", "_text_hash")


class WordHash(dict):
    """64-bit hashes of words (bytes), remembered; emptied when it has grown large."""

    LIMIT = 300_000

    def __init__(self, digest=xxhash.xxh3_64_intdigest):
        super().__init__()
        self.digest = digest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = self.digest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORD_HASH, SECOND_HASH = WordHash(), WordHash(xxhash.xxh64_intdigest)


_FORGET: dict[str, Callable[[], None]] = {}


def _give_back() -> None:
    """Freed memory goes back to the machine (with glibc, which else keeps it)."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def begin(operator: str, forget: Callable[[], None] | None = None) -> None:
    """At the start of a task: workers are reused, so what this one remembers for another operator goes. ``forget`` does that for this one."""
    others = [o for o in _FORGET if o != operator]
    for o in others:
        _FORGET.pop(o)()
    if others:
        _give_back()
    if forget:
        _FORGET[operator] = forget


def rest() -> None:
    """At the end of a partition: a worker that waits for its next task gives back what it remembers."""
    WORD_HASH.clear()
    SECOND_HASH.clear()
    _give_back()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BLOCK = 1 << 16
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS:
        def run(b: int) -> np.ndarray:
            a = np.full(_BLOCK + 64, b, np.uint64)
            a[0] = 1
            return np.multiply.accumulate(a)

        _POWERS[base] = run(base), run(pow(base, -1, 1 << 64))
    return _POWERS[base]


def gram_hashes(words: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each run of ``k`` (at most 50) consecutive words: a polynomial modulo 2**64, then mixed."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, inverse = _powers(base)
    out = np.empty(n, np.uint64)
    for at in range(0, n, _BLOCK - k):
        part = words[at : at + _BLOCK]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part * inverse[: len(part)], out=sums[1:])
        m = len(part) - k + 1
        out[at : at + m] = (sums[k:] - sums[:-k]) * power[k : k + m]
        if at + m >= n:
            break
    return mix(out)
