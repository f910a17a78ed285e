"""Online forms: transitions, edge counts and epochs of a stream of events.

In ``transitions`` order is arrival order across micro-batches and (ts, seq) inside one, as in the batch forms for
traces that arrive in order; state is one block (and one counter) a thread. ``ordered_transitions`` holds rows until the
watermark has passed them, so events may come late and mixed; state is then also the rows of up to twice ``late``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Transitions(StatefulProcessor):
    """Emits (thread, src, snk, epoch): keeps the thread's last block and its epoch, which grows at boundary transitions."""

    def __init__(self, boundaries: frozenset = frozenset()):
        self.boundaries = boundaries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "block string, epoch long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found = self.last.get() if self.last.exists() else None
        block, epoch = (found[0], found[1]) if found else (None, 0)
        for r in sorted(rows, key=lambda r: (r.ts, r.seq)):
            if block is not None:
                epoch += (block, r.block) in self.boundaries
                yield Row(thread=key[0], src=block, snk=r.block, epoch=epoch)
            block = r.block
        self.last.update((block, epoch))

    def close(self) -> None:
        pass


def transitions(events: DataFrame, boundaries: frozenset = frozenset()) -> DataFrame:
    """``thread, src, snk, epoch`` of a streaming trace ``thread, ts, seq, block``; needs the RocksDB state store."""
    return events.groupBy("thread").transformWithState(Transitions(boundaries), "thread long, src string, snk string, epoch long", "Append", "None")


class OrderedTransitions(StatefulProcessor):
    """As Transitions, in the order of (ts, seq) whatever the order of arrival: a row waits until the watermark is behind it.

    Waiting rows are kept by stretches of ``stretch`` milliseconds, of which a timer reads and removes those that are over. Each call of the state
    costs more than a row's work, so they follow the stretches that a thread has rows in; a batch adds a part to a stretch and reads none again.
    """

    def __init__(self, boundaries: frozenset = frozenset(), stretch: int = 1):
        self.boundaries, self.stretch = boundaries, stretch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "block string, epoch long")
        self.parts = handle.getMapState("parts", "stretch long", "n int")
        self.waiting = handle.getMapState("waiting", "stretch long, part int", "rows array<struct<us: long, seq: long, block: string>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh: dict[int, list] = {}
        for r in rows:
            fresh.setdefault(r.us // 1000 // self.stretch, []).append((r.us, r.seq, r.block))
        for at, more in fresh.items():
            n = self.parts.getValue((at,))[0] if self.parts.containsKey((at,)) else 0
            self.waiting.updateValue((at, n), (more,))
            self.parts.updateValue((at,), (n + 1,))
            if not n:
                # The moment after the stretch: once the watermark has reached it, no row of the stretch can come.
                self.handle.registerTimer((at + 1) * self.stretch)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs() // self.stretch - 1
        if not self.parts.containsKey((at,)):
            return
        due = []
        for i in range(self.parts.getValue((at,))[0]):
            due += map(tuple, self.waiting.getValue((at, i))[0])
            self.waiting.removeKey((at, i))
        self.parts.removeKey((at,))
        found = self.last.get() if self.last.exists() else None
        block, epoch = (found[0], found[1]) if found else (None, 0)
        for _, _, now in sorted(due, key=lambda r: r[:2]):
            if block is not None:
                epoch += (block, now) in self.boundaries
                yield Row(thread=key[0], src=block, snk=now, epoch=epoch)
            block = now
        self.last.update((block, epoch))

    def close(self) -> None:
        pass


def ordered_transitions(events: DataFrame, late: str, boundaries: frozenset = frozenset()) -> DataFrame:
    """``thread, src, snk, epoch`` of a streaming trace ``thread, ts timestamp, seq, block`` whose events come up to ``late`` after
    later ones. What comes later still is dropped by the watermark; the rows of the last ``late``, and of up to as long before,
    stay in the state until later events move it on. Rows without a thread or time, and those up to the
    first moment of 1970, where watermarks begin, are left out. Needs the RocksDB state store.
    """
    timed = events.where("thread IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    whole = events.sparkSession.range(1).select(F.expr(f"unix_millis(timestamp_seconds(0) + INTERVAL '{late}')")).first()[0]
    return timed.groupBy("thread").transformWithState(OrderedTransitions(boundaries, max(whole, 1)), "thread long, src string, snk string, epoch long", "Append", "EventTime")


def edge_counts(moves: DataFrame) -> DataFrame:
    """Running edge counts, for complete or update output of ``foreachBatch`` totals."""
    return moves.groupBy("src", "snk").agg(F.count("*").alias("freq"))


def time_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``thread, start, end, n``: sessions by a gap in event time, with a watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("thread", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("thread", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
