"""Ordered scans of long series without one task per series.

A series is cut into buckets of time. Inside a bucket a window does the work; what a bucket hands to the next is one row per bucket, scanned by a
second window over buckets, and joined back. A hot series thus takes as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000


def _bucket(order: str, width: int) -> Column:
    return F.floor(F.col(order) / F.lit(width)).cast("long")


def ranked(df: DataFrame, keys: list[str], order: str, to: str, width: int = HOUR, distinct: bool = True, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with the rank of order within keys, from 1: of its distinct values, or of rows ordered by order and ties."""
    bucketed = df.withColumn("_b", _bucket(order, width))
    own = Window.partitionBy(*keys, "_b").orderBy(order, *ties)
    n = F.count_distinct(order) if distinct else F.count(F.lit(1))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy(*keys, "_b").agg(n.alias("_n")).select(*keys, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o"))
    rank = F.dense_rank() if distinct else F.row_number()
    return bucketed.withColumn("_r", rank.over(own)).join(offsets, [*keys, "_b"]).withColumn(to, F.col("_r") + F.col("_o")).drop("_b", "_r", "_o")


def with_previous(df: DataFrame, keys: list[str], order: str, columns: list[str], width: int = HOUR, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with prev_<column>: its value in the row before, by order and ties; null in the first row."""
    bucketed = df.withColumn("_b", _bucket(order, width))
    own = Window.partitionBy(*keys, "_b").orderBy(order, *ties)
    last = F.max_by(F.struct(*columns), F.struct(order, *ties)).alias("_last")
    over = Window.partitionBy(*keys).orderBy("_b")
    carried = bucketed.groupBy(*keys, "_b").agg(last).select(*keys, "_b", F.lag("_last").over(over).alias("_carried"))
    found = bucketed.withColumn("_own", F.lag(F.struct(*columns)).over(own)).join(carried, [*keys, "_b"])
    found = found.withColumn("_prev", F.coalesce("_own", "_carried"))
    return found.select(*df.columns, *(F.col(f"_prev.{c}").alias(f"prev_{c}") for c in columns))


def with_next(df: DataFrame, keys: list[str], order: str, columns: list[str], to: str, width: int = HOUR, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with a struct of the columns in the row after, by order and ties; null in the last row. A key's rows of one bucket are one task's, not all of its rows."""
    bucketed = df.withColumn("_b", _bucket(order, width))
    own = Window.partitionBy(*keys, "_b").orderBy(order, *ties)
    first = F.min_by(F.struct(*columns), F.struct(order, *ties)).alias("_first")
    over = Window.partitionBy(*keys).orderBy("_b")
    carried = bucketed.groupBy(*keys, "_b").agg(first).select(*keys, "_b", F.lead("_first").over(over).alias("_carried"))
    found = bucketed.withColumn("_own", F.lead(F.struct(*columns)).over(own)).join(carried, [*keys, "_b"])
    return found.select(*df.columns, F.coalesce("_own", "_carried").alias(to))


def running(df: DataFrame, keys: list[str], order: str, value: str, to: str, width: int = HOUR, ties: tuple[str, ...] = (), kind: str = "sum", inclusive: bool = True) -> DataFrame:
    """df with the running sum or maximum of value, with or without the row itself."""
    fold = {"sum": F.sum, "max": F.max}[kind]
    join = (lambda a, b: F.coalesce(a + b, a, b)) if kind == "sum" else F.greatest
    bucketed = df.withColumn("_b", _bucket(order, width))
    own = Window.partitionBy(*keys, "_b").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = bucketed.groupBy(*keys, "_b").agg(fold(value).alias("_n")).select(*keys, "_b", fold("_n").over(earlier).alias("_o"))
    return bucketed.withColumn("_r", fold(value).over(own)).join(carried, [*keys, "_b"]).withColumn(to, join(F.col("_r"), F.col("_o"))).drop("_b", "_r", "_o")
