"""Running values along ordered keys whose rows may be too many for one sort.

With ``bucket_seconds`` a key is cut by time: each bucket is sorted by itself, and what the buckets before it
leave behind (one row a bucket) is carried over by a join. Rows of one instant stay together. Without it a key is one window.
Null keys and null times are keys and a bucket of their own; the latter comes first, as nulls do in the order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS, ORDER = ("thread",), ("ts", "seq")


def _bucketed(df: DataFrame, by: str, bucket_seconds: int) -> DataFrame:
    return df.withColumn("_bucket", F.floor(F.unix_timestamp(F.col(by).cast("timestamp")) / bucket_seconds))


def _carry(inside: DataFrame, kept: DataFrame, keys: tuple[str, ...], value: Column, name: str) -> DataFrame:
    """``inside`` with ``name``: ``value`` over the buckets before in ``kept`` (one row a key and bucket)."""
    on = (*keys, "_bucket")
    small = kept.withColumn(name, value).select(*(F.col(c).alias(f"_of_{c}") for c in on), name)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on))
    return inside.join(small, same, "left").drop("_bucket", *(f"_of_{c}" for c in on))


def previous(df: DataFrame, column: str, name: str, keys: tuple[str, ...] = KEYS, order: tuple[str, ...] = ORDER, bucket_seconds: int | None = None) -> DataFrame:
    """``df`` with ``name``, the value of ``column`` in the row before; null where there is none."""
    held = F.struct(F.col(column).alias("v"))
    if bucket_seconds is None:
        return df.withColumn(name, F.lag(held).over(W.partitionBy(*keys).orderBy(*order))["v"])
    cut = _bucketed(df, order[0], bucket_seconds)
    inside = cut.withColumn("_before", F.lag(held).over(W.partitionBy(*keys, "_bucket").orderBy(*order)))
    last = cut.groupBy(*keys, "_bucket").agg(F.max_by(held, F.struct(*order)).alias("_last"))
    carried = _carry(inside, last, keys, F.lag("_last").over(W.partitionBy(*keys).orderBy("_bucket")), "_carried")
    return carried.withColumn(name, F.coalesce("_before", "_carried")["v"]).drop("_before", "_carried")


def _running(df, value, name, keys, order, bucket_seconds, fold, combine):
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, W.currentRow)
    if bucket_seconds is None:
        return df.withColumn(name, fold(value).over(upto(W.partitionBy(*keys).orderBy(*order))))
    cut = _bucketed(df, order[0], bucket_seconds).withColumn("_value", value)
    inside = cut.withColumn("_inside", fold("_value").over(upto(W.partitionBy(*keys, "_bucket").orderBy(*order))))
    whole = cut.groupBy(*keys, "_bucket").agg(fold("_value").alias("_whole"))
    before = fold("_whole").over(W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    carried = _carry(inside, whole, keys, before, "_carried")
    return carried.withColumn(name, combine(F.col("_carried"), F.col("_inside"))).drop("_value", "_inside", "_carried")


def total(df: DataFrame, value: Column, name: str, keys: tuple[str, ...] = KEYS, order: tuple[str, ...] = ORDER, bucket_seconds: int | None = None) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` up to and with the row; null as long as all values are."""
    both = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    return _running(df, value, name, keys, order, bucket_seconds, F.sum, both)


def peak(df: DataFrame, value: Column, name: str, keys: tuple[str, ...] = KEYS, order: tuple[str, ...] = ORDER, bucket_seconds: int | None = None) -> DataFrame:
    """``df`` with ``name``, the greatest ``value`` up to and with the row."""
    return _running(df, value, name, keys, order, bucket_seconds, F.max, F.greatest)
