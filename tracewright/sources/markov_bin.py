"""Binary transition profile as a Spark data source, ``format("markov_bin")``.

Little-endian: ``u32 order, u32 blocks, u32 edges``, then an edge each: ``u32 * order`` source
state, ``u32`` sink, ``u64`` frequency. A file is split into byte ranges of whole edges, so
one large profile is read by many tasks. Writing gives one file a partition, each with its own header.
"""

from __future__ import annotations

import glob
import os
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

HEADER = struct.Struct("<III")
SPLIT_EDGES = 1 << 20


def layout(order: int) -> np.dtype:
    return np.dtype([("src", "<u4", (order,)), ("snk", "<u4"), ("freq", "<u8")])


@dataclass
class Range(InputPartition):
    path: str
    order: int
    first: int
    count: int


@dataclass
class Written(WriterCommitMessage):
    path: str
    edges: int


class MarkovReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        files = sorted(glob.glob(os.path.join(self.path, "*.bin"))) if os.path.isdir(self.path) else [self.path]
        out = []
        for name in files:
            with open(name, "rb") as f:
                raw = f.read(HEADER.size)
            if len(raw) < HEADER.size:
                raise ValueError(f"{name}: no header")
            order, _, edges = HEADER.unpack(raw)
            if os.path.getsize(name) < HEADER.size + edges * layout(order).itemsize:
                raise ValueError(f"{name}: fewer edges than the header says")
            out += [Range(name, order, at, min(SPLIT_EDGES, edges - at)) for at in range(0, edges, SPLIT_EDGES)]
        return out or [Range("", 1, 0, 0)]

    def read(self, part: Range):
        if not part.count:
            return
        kind = layout(part.order)
        with open(part.path, "rb") as f:
            f.seek(HEADER.size + part.first * kind.itemsize)
            rows = np.frombuffer(f.read(part.count * kind.itemsize), kind)
        ends = np.arange(len(rows) + 1, dtype=np.int32) * part.order
        state = pa.ListArray.from_arrays(pa.array(ends), pa.array(rows["src"].reshape(-1).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([state, pa.array(rows["snk"].astype(np.int64)), pa.array(rows["freq"].astype(np.int64))], ["src_state", "snk", "freq"])


class MarkovWriter(DataSourceArrowWriter):
    def __init__(self, path: str, blocks: int, overwrite: bool):
        self.path, self.blocks, self.overwrite = path, blocks, overwrite
        if os.path.isdir(path) and os.listdir(path) and not overwrite:
            raise ValueError(f"{path} isn't empty")

    def write(self, batches):
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        task = TaskContext.get()
        name = os.path.join(self.path, f"part-{task.partitionId():05d}-{task.taskAttemptId()}.bin")
        order, edges = 1, 0
        with open(name + ".tmp", "wb") as f:
            f.write(HEADER.pack(0, 0, 0))
            for batch in batches:
                state = batch.column("src_state")
                if not batch.num_rows:
                    continue
                order = len(state[0])
                rows = np.zeros(batch.num_rows, layout(order))
                rows["src"] = state.flatten().to_numpy().reshape(-1, order)
                rows["snk"], rows["freq"] = batch.column("snk").to_numpy(), batch.column("freq").to_numpy()
                f.write(rows.tobytes())
                edges += batch.num_rows
            f.seek(0)
            f.write(HEADER.pack(order, self.blocks, edges))
        os.rename(name + ".tmp", name)
        return Written(name, edges)

    def commit(self, messages):
        kept = {m.path for m in messages if m}
        if self.overwrite:
            for old in glob.glob(os.path.join(self.path, "*.bin")):
                if old not in kept:
                    os.remove(old)

    def abort(self, messages):
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class MarkovDataSource(DataSource):
    @classmethod
    def name(cls):
        return "markov_bin"

    def schema(self):
        return "src_state array<bigint>, snk bigint, freq bigint"

    def reader(self, schema):
        return MarkovReader(self.options["path"])

    def writer(self, schema, overwrite):
        return MarkovWriter(self.options["path"], int(self.options.get("blocks", 0)), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MarkovDataSource)
