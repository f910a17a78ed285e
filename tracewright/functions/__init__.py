"""Column expressions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exponent(v: Column) -> Column:
    """floor(log2|v|) as a long, exact at powers of two; 0 for zero, null for null."""
    a = F.abs(v)
    e = F.floor(F.log2(a))
    exact = F.when(F.pow(F.lit(2.0), e + 1) <= a, e + 1).when(F.pow(F.lit(2.0), e) > a, e - 1).otherwise(e)
    return F.when(v.isNull(), F.lit(None).cast("long")).when(v == 0, F.lit(0).cast("long")).otherwise(exact.cast("long"))


def surprise(w: Column) -> Column:
    """w * log2(w), 0 for weight 0."""
    return F.when(w > 0, w * F.log2(w)).otherwise(F.lit(0.0))


def precision_type(spark_type: str) -> str:
    """Name of the value class that a Spark type is histogrammed under; others have no exponent."""
    return {"boolean": "bool", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float", "double": "double"}.get(spark_type, "void")
