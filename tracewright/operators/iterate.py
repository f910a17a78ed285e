"""Support for fixpoints: reliable checkpoints and connected components."""

from __future__ import annotations

import atexit
import dataclasses
import shutil
import tempfile
import uuid
from functools import cache, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes up to which a counted table is broadcast.
BROADCAST_BYTES = 24 << 20
#: Rows of a partition that one task sorts.
PARTITION_ROWS = 400_000


@cache
def _own_folder() -> str:
    """A folder of this process, for local masters alone; it goes when the process ends."""
    path = tempfile.mkdtemp(prefix="tracewright-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, which only a local master may leave unset."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return _own_folder()


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of any store that Spark can reach."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder; lineage ends there and survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """``checkpoint(df)`` without what the optimiser knew of its columns: in fixpoints over self-joins those facts, one for each name a column
    has had, multiply from round to round, and planning soon takes longer than the work."""
    done, spark = checkpoint(df), df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(done._jdf.javaRDD(), done._jdf.schema()), spark)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of ``stored`` frames, for each running call of a ``tidy`` function.
_made: list[list[str]] = []


def stored(df: DataFrame) -> DataFrame:
    """As ``settled``, but as Parquet, which takes a fraction of a checkpoint's disk; the shuffle files of the work go as soon as it is written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if _made:
        _made[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _frames(out) -> list[DataFrame]:
    if isinstance(out, DataFrame):
        return [out]
    if dataclasses.is_dataclass(out):
        return _frames([getattr(out, f.name) for f in dataclasses.fields(out)])
    return [f for x in out for f in _frames(x)] if isinstance(out, (tuple, list)) else []


def tidy(function):
    """``function``, at whose end the frames that it ``stored`` go, but those that its result reads."""

    @wraps(function)
    def call(*args, **kwargs):
        _made.append([])
        try:
            out = function(*args, **kwargs)
        finally:
            made = _made.pop()
        frames = _frames(out)
        used = {part for f in frames for file in f.inputFiles() for part in file.split("/") if part.startswith("stored-")} if made else set()
        for path in made:
            if path.rsplit("/", 1)[1] not in used:
                remove(frames[0].sparkSession, path)
            elif _made:
                _made[-1].append(path)
        return out

    return call


def partitions(df: DataFrame, rows: int = PARTITION_ROWS) -> int:
    """Partitions of about ``rows`` rows for ``df``, which is counted; enough for all cores."""
    spark = df.sparkSession
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return max(least, -(-df.count() // rows))


def spread(df: DataFrame, *by: str, n: int | None = None) -> DataFrame:
    """``df`` in ``n`` partitions by columns, by default so many that each has about ``PARTITION_ROWS`` rows.

    A sort, window or sweep works on a partition at a time: with a number of partitions, or of bytes in one, that doesn't
    follow the rows, its memory grows with the input.
    """
    return df.repartition(n or partitions(df), *by)


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` (already checkpointed) with a broadcast hint if its rows are counted to fit BROADCAST_BYTES."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def stars(edges: DataFrame) -> DataFrame:
    """``a, b``: each connected node of the undirected ``edges(a, b)`` but the least of its component, with that one.

    Alternating large and small stars: a number of rounds about logarithmic in the longest
    path; edges only, no adjacency is ever collected. A node with very many edges is only
    ever aggregated: its neighbours meet it through a broadcast table of one row a node, or, beyond
    that size, through a join whose hot keys can be split, as both sides are checkpointed.
    """
    star = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(small_side(least, 24), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        # After the large star only smaller neighbours are left, few a node.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = checkpoint(large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct())
        now = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return small
        star, before = small, now


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, root`` of every id in ``nodes(id)``; root is the least id of the component under ``edges(a, b)``."""
    star = stars(edges)
    return nodes.join(star.select(F.col("a").alias("id"), "b"), "id", "left").select("id", F.coalesce("b", "id").alias("root"))
