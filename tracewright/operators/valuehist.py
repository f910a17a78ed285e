"""Histograms of value exponents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import exponent


def histogram(values: DataFrame) -> DataFrame:
    """``epoch, exponent, n`` of ``values(epoch, value)``; null values don't count."""
    return values.where("value IS NOT NULL").groupBy("epoch", exponent(F.col("value")).alias("exponent")).agg(F.count("*").alias("n"))


def pivot(hist: DataFrame, bins: list[int]) -> DataFrame:
    """One row an epoch, one column ``e<bin>`` a bin, zeros where nothing was seen."""
    cells = (F.coalesce(F.sum(F.when(F.col("exponent") == b, F.col("n"))), F.lit(0)).cast("long").alias(f"e{b}".replace("-", "m")) for b in bins)
    return hist.groupBy("epoch").agg(*cells)
