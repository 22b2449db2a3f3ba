"""Post-processing of numeric series (series_id, ts, val).

A table without rows has no series and gives none; a series that is too short for an operator is an error. width: milliseconds of the buckets of time in which long series are scanned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .scan import HOUR, ranked, with_previous

MINUTE = 60_000
#: Rows of a block in scans that go by row number; rows up to which Spark keeps the best of a group before its shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
BLOCK, TOP = 10_000, 1000
#: Weights of smoothing fade no further, so that a value that is infinite or NaN stays in a series however long it is.
FAINT = 5e-324


def _guarded(df: DataFrame, least: int, what: str) -> DataFrame:
    """df, failing when a series has fewer than least rows."""
    short = df.groupBy("series_id").agg(F.count(F.lit(1)).alias("_n"))
    failed = F.raise_error(F.concat(F.lit(what), F.lit(": too few rows in series "), F.col("series_id").cast("string")))
    checked = short.withColumn("_n", F.when(F.col("_n") >= least, F.col("_n")).otherwise(failed.cast("bigint")))
    return df.join(checked, "series_id").where("_n is not null").drop("_n")


def log_delta(series: DataFrame, width: int = HOUR) -> DataFrame:
    """(series_id, ts, val): the natural logarithm of each value over the one before; a series of one row is an error."""
    found = with_previous(_guarded(series, 2, "log_delta"), ["series_id"], "ts", ["val"], width)
    return found.where("prev_val is not null").select("series_id", "ts", F.ln(F.col("val") / F.col("prev_val")).alias("val"))


def smoothed(values: np.ndarray, begins: np.ndarray, weight: float) -> np.ndarray:
    """s[i] = values[i] + weight s[i - 1], anew from each i that begins, by doubling: after each pass a value sums up twice as many of those before it."""
    at = np.arange(len(values))
    since = at - np.maximum.accumulate(np.where(begins, at, 0))
    out, step = values.astype(float), 1
    while step <= since.max(initial=0):
        out[step:] = np.where(since[step:] >= step, out[step:] + weight * out[:-step], out[step:])
        step, weight = 2 * step, max(weight * weight, FAINT)
    return out


def _smoothing(weight: float):
    """For mapInArrow: rows in order with x, begins and ahead; x becomes the smoothed value, and rows that are ahead of a block are left out. Any number of blocks goes through one batch, and a block through any number of batches."""

    def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            values, begins = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "begins"))
            values = values.copy()
            if not begins[0]:
                values[0] += weight * last
            values = smoothed(values, begins, weight)
            last = values[-1]
            done = batch.set_column(batch.schema.get_field_index("x"), "x", pa.array(values)).filter(pc.invert(batch.column("ahead")))
            yield done.select([c for c in done.schema.names if c not in ("begins", "ahead")])

    return smooth


def scanned(rows: DataFrame, weight: float, block: int, longest: int) -> DataFrame:
    """rows (series_id, i, x and others; i from 1 without a gap) with x plus weight times the result of the row before, in place of x. longest: the rows of the longest series.

    What a block of rows hands on, as if nothing came before it, is a series with a row for each block and the weight of a whole block. It is scanned in the same way,
    in blocks of BLOCK, and its results go ahead of the blocks that follow. So all levels together cost little more than the rows do.
    """
    names, types = rows.columns, rows.schema
    rows = rows.withColumn("block", F.floor((F.col("i") - 1) / block).cast("long")).withColumn("ahead", F.lit(False))
    if longest > block:
        # weights fade with distance to the block's end. A last block that is not full hands on to none
        faded = F.col("x") * F.greatest(F.pow(F.lit(weight), (F.col("block") + 1) * block - F.col("i")), F.lit(FAINT))
        ends = rows.groupBy("series_id", "block").agg(F.sum(faded).alias("x")).select("series_id", (F.col("block") + 1).alias("i"), "x")
        ends = scanned(stored(ends, "ends"), max(weight**block, FAINT), BLOCK, -(-longest // block))
        starts = ends.select("series_id", F.col("i").alias("block"), (F.col("i") * block).alias("i"), "x", F.lit(True).alias("ahead"))
        rows = rows.unionByName(starts, allowMissingColumns=True)
    rows = rows.repartition("series_id", "block").sortWithinPartitions("block", "series_id", "i")
    begins = (F.col("ahead") | (F.col("i") == 1)).alias("begins")
    return rows.select(*names, begins, "ahead").mapInArrow(_smoothing(weight), types)


def exp_smoothing(series: DataFrame, alpha: float, block: int = BLOCK, width: int = HOUR) -> DataFrame:
    """(series_id, ts, val): s0 = x0, s = alpha x + (1 - alpha) s before, in double; null from a value that is null or NaN on.

    Each block of rows is smoothed from its own start, so a hot series is as many tasks' as it has blocks; starts come from what blocks hand on. Tasks go through
    their blocks batch by batch, so blocks of few rows cost little more than large ones.
    """
    if not 0 < alpha < 1:
        raise ValueError(f"alpha must be between 0 and 1, not {alpha}")
    rows = stored(ranked(series.select("series_id", "ts", F.col("val").cast("double").alias("val")), ["series_id"], "ts", "i", width, distinct=False), "ranked")
    # the first value of all has weight 1. NaN stands for null, since sums leave nulls out
    x = F.coalesce(F.when(F.col("i") == 1, F.col("val")).otherwise(alpha * F.col("val")), F.lit(float("nan")))
    longest = rows.agg(F.max("i")).first()[0] or 0
    found = scanned(rows.select("series_id", "i", "ts", x.alias("x")), 1 - alpha, block, longest)
    return found.select("series_id", "ts", F.when(~F.isnan("x"), F.col("x")).alias("val"))


def rolling(series: DataFrame, n: int, kind: str, block: int = BLOCK, width: int = HOUR) -> DataFrame:
    """(series_id, ts, val): mean or population variance (kind: mean, var) of each row and the n - 1 before it; only full frames.

    Rows go to blocks by their number, and each block also gets the n - 1 rows before it.
    """
    if n <= 0:
        raise ValueError(f"n must be positive, not {n}")
    if kind not in ("mean", "var"):
        raise ValueError(f"kind must be mean or var, not {kind}")
    size = max(block, n)
    rows = ranked(series, ["series_id"], "ts", "i", width, distinct=False).withColumn("block", F.floor((F.col("i") - 1) / size).cast("long"))
    copies = F.when((F.col("i") - 1) % size >= size - (n - 1), F.array(F.col("block"), F.col("block") + 1)).otherwise(F.array("block"))
    spread = rows.withColumn("home", F.col("block")).withColumn("block", F.explode(copies))
    over = Window.partitionBy("series_id", "block").orderBy("i").rowsBetween(-(n - 1), 0)
    fold = F.avg if kind == "mean" else F.var_pop
    return spread.withColumn("val", fold("val").over(over)).where((F.col("home") == F.col("block")) & (F.col("i") >= n)).select("series_id", "ts", "val")


def last_n(series: DataFrame, n: int, kind: str, width: int = HOUR) -> DataFrame:
    """(series_id, val): mean or population variance of the last n values; an n below 1 or above a series' length is an error.

    A task keeps the last n rows of each series before anything is shuffled; above TOP rows, only those of the last buckets that hold so many are looked at.
    """
    if n <= 0:
        raise ValueError(f"n must be positive, not {n}")
    if kind not in ("mean", "var"):
        raise ValueError(f"kind must be mean or var, not {kind}")
    rows = series.select("series_id", "ts", "val")
    if n > TOP:
        bucketed = rows.withColumn("_b", F.floor(F.col("ts") / width).cast("long"))
        later = Window.partitionBy("series_id").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
        sizes = bucketed.groupBy("series_id", "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_later", F.coalesce(F.sum("_n").over(later), F.lit(0)))
        rows = bucketed.join(sizes.where(F.col("_later") < n).select("series_id", "_b"), ["series_id", "_b"], "left_semi").drop("_b")
    last = rows.withColumn("_i", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("ts")))).where(F.col("_i") <= n)
    found = last.groupBy("series_id").agg((F.avg if kind == "mean" else F.var_pop)("val").alias("val"), F.count(F.lit(1)).alias("_n"))
    short = F.raise_error(F.concat(F.lit("last_n: too few rows in series "), F.col("series_id").cast("string"))).cast("double")
    return found.select("series_id", F.when(F.col("_n") == n, F.col("val")).otherwise(short).alias("val"))


def series_gap(a: DataFrame, b: DataFrame, fill_value: float | None = 0.0) -> DataFrame:
    """(series_id, ts, val): a minus b where either has a row; a missing or NaN side counts as fill_value, both missing stay null."""
    clean = lambda df, c: df.select("series_id", "ts", F.when(~F.isnan(F.col("val").cast("double")), F.col("val").cast("double")).alias(c))
    both = clean(a, "x").join(clean(b, "y"), ["series_id", "ts"], "full")
    fill = F.lit(fill_value).cast("double")
    val = F.when(F.col("x").isNull() & F.col("y").isNull(), None).otherwise(F.coalesce("x", fill) - F.coalesce("y", fill))
    return both.select("series_id", "ts", val.alias("val"))


def minute_mean(series: DataFrame) -> DataFrame:
    """(series_id, minute, val): the mean of each minute that has rows."""
    return series.groupBy("series_id", F.floor(F.col("ts") / MINUTE).cast("long").alias("minute")).agg(F.avg("val").alias("val"))


def price_change_intervals(series: DataFrame, minutes: int = 5, change: float = 0.05, on_gap: str = "raise") -> DataFrame:
    """(series_id, start_minute, end_minute, val): (max - min) / min of the minute means from a minute to so many later, where above change.

    Only full frames count. on_gap: raise when a minute inside a frame is missing, or skip that frame.
    """
    if on_gap not in ("raise", "skip"):
        raise ValueError(f"on_gap must be raise or skip, not {on_gap}")
    means = minute_mean(series)
    # each mean goes to the frames that hold it; a frame is one group
    spread = means.select("series_id", "minute", "val", F.explode(F.sequence(F.col("minute") - minutes, F.col("minute"))).alias("start_minute"))
    ends = means.groupBy("series_id").agg(F.min("minute").alias("first"), F.max("minute").alias("last"))
    frames = spread.groupBy("series_id", "start_minute").agg(F.min("val").alias("low"), F.max("val").alias("high"), F.count(F.lit(1)).alias("n"))
    frames = frames.join(ends, "series_id")
    inside = (F.col("start_minute") >= F.col("first")) & (F.col("start_minute") + minutes <= F.col("last"))
    missing = F.raise_error(F.format_string("a minute is missing after %d", F.col("start_minute"))).cast("boolean")
    # one condition: apart, the error could be tested before the frame's place is
    whole = F.when(~inside, False).when(F.col("n") == minutes + 1, True).otherwise(missing if on_gap == "raise" else F.lit(False))
    val = F.when(whole, (F.col("high") - F.col("low")) / F.col("low"))
    return frames.select("series_id", "start_minute", (F.col("start_minute") + minutes).alias("end_minute"), val.alias("val")).where(F.abs("val") > change)


def _as_ms(at) -> Column:
    """A point in time as milliseconds: an integer or a timestamp."""
    if isinstance(at, bool) or not isinstance(at, (int, pd.Timestamp)):
        raise TypeError(f"a time is an integer of milliseconds or a timestamp, not {type(at).__name__}")
    return F.lit(at if isinstance(at, int) else at.value // 1_000_000)


def series_at(series: DataFrame, at) -> DataFrame:
    """The rows at one time, in milliseconds or as a timestamp."""
    return series.where(F.col("ts") == _as_ms(at))


def series_between(series: DataFrame, first, last) -> DataFrame:
    """The rows from first to last, both included."""
    return series.where(F.col("ts").between(_as_ms(first), _as_ms(last)))
