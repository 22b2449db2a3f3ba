"""Depth indicators on a regular time grid. A new one is one aggregate expression over the best levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .book import book_grid, check_grid, grid_points, stale_points


def book_metric(books: DataFrame, value: Column, n_levels: int, side: str, start: int, end: int, step: int, on_shallow: str = "raise", on_snapshot: str = "replace", max_interval: int | None = None, on_stale: str = "raise") -> DataFrame:
    """(instId, side, ts, val): an aggregate over the best n_levels levels (columns lvl, price, size, numOrders) at each grid point.

    side: ask, bid, or total for both, each on its own. on_shallow: what a book of fewer levels gives, an error, or null.
    max_interval: the longest time in milliseconds since an instrument's last row, if there is a limit. on_stale: what a point past it, or before
    the first row, gives: an error, null, or keep for the value as it stands; staleness goes before depth.
    """
    check_grid(start, end, step, n_levels, side)
    if on_stale not in ("raise", "null", "keep"):
        raise ValueError(f"on_stale must be raise, null or keep, not {on_stale}")
    if max_interval is not None and max_interval < 0:
        raise ValueError(f"max_interval must not be negative, not {max_interval}")
    if on_shallow not in ("raise", "null"):
        raise ValueError(f"on_shallow must be raise or null, not {on_shallow}")
    grid = book_grid(books, start, end, step, n_levels, on_snapshot)
    points = grid_points(books, start, end, step)
    if side != "total":
        grid, points = grid.where(F.col("side") == side), points.where(F.col("side") == side)
    found = grid.groupBy("instId", "side", "ts").agg(value.alias("val"), F.count(F.lit(1)).alias("n"))
    deep = F.coalesce(F.col("n"), F.lit(0)) >= n_levels
    shallow = F.lit(None).cast("double") if on_shallow == "null" else F.raise_error(F.format_string("fewer than %d levels: %s %s at %d", F.lit(n_levels), F.col("instId"), F.col("side"), F.col("ts"))).cast("double")
    val = F.when(deep, F.col("val")).otherwise(shallow)
    joined = points.join(found, ["instId", "side", "ts"], "left")
    if max_interval is not None and on_stale != "keep":
        old = stale_points(books, start, end, step, max_interval).select("instId", "ts", F.lit(True).alias("stale"))
        joined = joined.join(old, ["instId", "ts"], "left")
        stale = F.lit(None).cast("double") if on_stale == "null" else F.raise_error(F.format_string("no row of %s for %d ms at %d", F.col("instId"), F.lit(max_interval), F.col("ts"))).cast("double")
        val = F.when(F.col("stale"), stale).otherwise(val)
    return joined.select("instId", "side", "ts", val.alias("val"))


def total_amount(books: DataFrame, n_levels: int, side: str, start: int, end: int, step: int, **more) -> DataFrame:
    return book_metric(books, F.sum("size"), n_levels, side, start, end, step, **more)


def total_value(books: DataFrame, n_levels: int, side: str, start: int, end: int, step: int, **more) -> DataFrame:
    return book_metric(books, F.sum(F.col("price") * F.col("size")), n_levels, side, start, end, step, **more)


def mean_price(books: DataFrame, n_levels: int, side: str, start: int, end: int, step: int, **more) -> DataFrame:
    return book_metric(books, F.avg("price"), n_levels, side, start, end, step, **more)


def weighted_price(books: DataFrame, n_levels: int, side: str, start: int, end: int, step: int, **more) -> DataFrame:
    return book_metric(books, F.sum(F.col("price") * F.col("size")) / F.sum("size"), n_levels, side, start, end, step, **more)


def level_changes(books: DataFrame, side: str, start: int, end: int, step: int, on_snapshot: str = "replace") -> DataFrame:
    """(instId, side, ts, val): how many ranks of the book differ, in price, size or number of orders, from one step before; total adds both sides.

    Each grid row is at once the present of its own point and the past of the next, so one aggregate compares them.
    """
    check_grid(start, end, step, side=side)
    level = F.struct("price", "size", "numOrders")
    none = F.lit(None).cast("struct<price:double,size:double,numOrders:bigint>")
    grid = book_grid(books, start - step, end, step, on_snapshot=on_snapshot)
    both = grid.select("instId", "side", "lvl", F.explode(F.array(F.struct(F.col("ts"), level.alias("now"), none.alias("past")), F.struct((F.col("ts") + step).alias("ts"), none.alias("now"), level.alias("past")))).alias("x")).select("instId", "side", "lvl", "x.*")
    ranks = both.groupBy("instId", "side", "ts", "lvl").agg(F.max("now").alias("now"), F.max("past").alias("past"))
    changed = ranks.groupBy("instId", "side", "ts").agg(F.count_if(~F.col("now").eqNullSafe(F.col("past"))).alias("n"))
    found = grid_points(books, start, end, step).join(changed, ["instId", "side", "ts"], "left").withColumn("val", F.coalesce(F.col("n"), F.lit(0)).cast("double")).drop("n")
    if side == "total":
        return found.groupBy("instId", "ts").agg(F.sum("val").alias("val")).select("instId", F.lit("total").alias("side"), "ts", "val")
    return found.where(F.col("side") == side)


def depth_by_ts(books: DataFrame, start: int, end: int, step: int, on_snapshot: str = "replace") -> DataFrame:
    """(instId, side, ts, depth): levels of each side at each grid point, 0 for an empty one."""
    depth = book_grid(books, start, end, step, on_snapshot=on_snapshot).groupBy("instId", "side", "ts").agg(F.count(F.lit(1)).alias("n"))
    return grid_points(books, start, end, step).join(depth, ["instId", "side", "ts"], "left").select("instId", "side", "ts", F.coalesce("n", F.lit(0)).alias("depth"))


def mid_price(books: DataFrame, start: int, end: int, step: int, on_snapshot: str = "replace") -> DataFrame:
    """(instId, ts, mid): half the sum of the best ask and bid; null where a side is empty. The grid is anchored at start, whatever that is."""
    books = books.withColumn("timestamp", F.col("timestamp") - start)
    last = (end - start) // step * step
    best = book_grid(books, 0, last, step, 1, on_snapshot).groupBy("instId", "ts").agg(*(F.max(F.when(F.col("side") == s, F.col("price"))).alias(s) for s in ("ask", "bid")))
    points = grid_points(books, 0, last, step, by_side=False).join(best, ["instId", "ts"], "left")
    return points.select("instId", (F.col("ts") + start).alias("ts"), ((F.col("ask") + F.col("bid")) / 2).alias("mid"))
