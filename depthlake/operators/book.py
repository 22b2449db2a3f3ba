"""Order books as validity intervals.

A row of a snapshot-and-update feed says that a level (instId, side, price) has a size from its timestamp on, until the next row of that level or the
next snapshot, which clears the book. All book states follow from these intervals without replay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import HOUR, ranked, running, with_next

LEVEL = ["instId", "side", "price"]


def check_grid(start: int, end: int, step: int, n_levels: int | None = None, side: str | None = None) -> None:
    """Arguments of a regular time grid in milliseconds."""
    if step <= 0 or start % step or end % step or end < start:
        raise ValueError(f"start {start} and end {end} must be multiples of the step {step}, in order")
    if n_levels is not None and n_levels <= 0:
        raise ValueError(f"N must be positive, not {n_levels}")
    if side not in (None, "ask", "bid", "total"):
        raise ValueError(f"no such side: {side}")


DAY = 86_400_000


def snapshot_times(books: DataFrame) -> DataFrame:
    """(instId, day, snaps, later): for every day with rows, the sorted timestamps of groups whose first row is a snapshot, and the first such of a later day."""
    day = F.floor(F.col("timestamp") / DAY).alias("day")
    groups = books.groupBy("instId", "timestamp").agg(F.min_by("action", "seq").alias("action"))
    days = groups.groupBy("instId", day).agg(F.sort_array(F.collect_list(F.when(F.col("action") == "snapshot", F.col("timestamp")))).alias("snaps"))
    following = Window.partitionBy("instId").orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    return days.withColumn("later", F.min(F.get("snaps", 0)).over(following))


def level_rows(books: DataFrame, on_snapshot: str = "replace", width: int = HOUR) -> DataFrame:
    """books with until: the timestamp of the row or snapshot that ends each level's value; null if nothing does.

    What follows a row is found inside buckets of width milliseconds, and the first row of a bucket is handed back to the one before, so a level may hold any share of all rows.
    """
    if on_snapshot not in ("replace", "upsert"):
        raise ValueError(f"on_snapshot must be replace or upsert, not {on_snapshot}")
    following = with_next(books, LEVEL, "timestamp", ["timestamp"], "_next", width, ties=("seq",)).withColumn("_next", F.col("_next.timestamp"))
    if on_snapshot == "upsert":
        return following.withColumnRenamed("_next", "until")
    cleared = following.withColumn("day", F.floor(F.col("timestamp") / DAY)).join(snapshot_times(books), ["instId", "day"])
    clearing = F.expr("coalesce(get(filter(snaps, s -> s > timestamp), 0), later)")
    return cleared.withColumn("until", F.least("_next", clearing)).drop("_next", "snaps", "later", "day")


def level_intervals(books: DataFrame, on_snapshot: str = "replace", width: int = HOUR) -> DataFrame:
    """(instId, side, price, size, numOrders, valid_from, valid_to): when each level stood in the book; valid_to is null for the last."""
    rows = level_rows(books, on_snapshot, width).where("cast(size as double) > 0 and (until is null or until > timestamp)")
    return rows.select(*LEVEL, "size", "numOrders", F.col("timestamp").alias("valid_from"), F.col("until").alias("valid_to"))


def by_price(side: str = "side", price: str = "price") -> Column:
    """Best first: asks ascending, bids descending."""
    return F.when(F.col(side) == "ask", F.col(price)).otherwise(-F.col(price))


def book_grid(books: DataFrame, start: int, end: int, step: int, n_levels: int | None = None, on_snapshot: str = "replace") -> DataFrame:
    """(instId, ts, side, lvl, price, size, numOrders): the book at start, start + step, ... end; lvl 1 is the best level.

    Each interval lists the grid points that it covers: an as-of join without a join.
    """
    check_grid(start, end, step, n_levels)
    first = F.greatest(F.ceil((F.col("valid_from") - start) / step), F.lit(0))
    last = F.least(F.ceil((F.col("valid_to") - start) / step) - 1, F.lit((end - start) // step))
    points = level_intervals(books, on_snapshot).select("*", first.cast("long").alias("k0"), last.cast("long").alias("k1")).where("k0 <= k1")
    points = points.select(*LEVEL, "size", "numOrders", F.explode(F.sequence("k0", "k1")).alias("k")).withColumn("ts", start + F.col("k") * step)
    over = Window.partitionBy("instId", "ts", "side").orderBy(by_price())
    grid = points.withColumn("lvl", F.row_number().over(over).cast("long")).select("instId", "ts", "side", "lvl", "price", "size", "numOrders")
    return grid if n_levels is None else grid.where(F.col("lvl") <= n_levels)


def grid_points(books: DataFrame, start: int, end: int, step: int, by_side: bool = True) -> DataFrame:
    """(instId, side, ts): every grid point of every instrument, so that empty books have rows too."""
    points = books.select("instId").distinct().select("instId", F.explode(F.sequence(F.lit(start), F.lit(end), F.lit(step))).alias("ts"))
    return points.select("instId", F.explode(F.array(F.lit("ask"), F.lit("bid"))).alias("side"), "ts") if by_side else points


def book_at(books: DataFrame, times: DataFrame, on_snapshot: str = "replace") -> DataFrame:
    """(instId, ts, side, price, size, numOrders): the full book at given (instId, ts).

    Intervals and times meet in hours: an interval lists the hours it touches, so that the join has keys.
    """
    hours = level_intervals(books, on_snapshot)
    asked = times.select("instId", "ts").distinct().withColumn("hour", F.floor(F.col("ts") / HOUR))
    span = asked.groupBy("instId").agg(F.min("hour").alias("h0"), F.max("hour").alias("h1"))
    hours = hours.join(span, "instId").withColumn("h0", F.greatest("h0", F.floor(F.col("valid_from") / HOUR))).withColumn("h1", F.least("h1", F.floor((F.col("valid_to") - 1) / HOUR))).where("h0 <= h1")
    hours = hours.withColumn("hour", F.explode(F.sequence("h0", "h1")))
    met = hours.join(asked, ["instId", "hour"]).where("valid_from <= ts and (valid_to is null or ts < valid_to)")
    return met.select("instId", "ts", "side", "price", "size", "numOrders")


def depth_events(books: DataFrame, on_snapshot: str = "replace") -> DataFrame:
    """(instId, side, ts, change): how many levels each timestamp opens and closes."""
    ends = F.array(F.struct(F.col("valid_from").alias("ts"), F.lit(1).alias("n")), F.struct(F.col("valid_to").alias("ts"), F.lit(-1).alias("n")))
    events = level_intervals(books, on_snapshot).select("instId", "side", F.explode(ends).alias("e")).where("e.ts is not null")
    return events.groupBy("instId", "side", F.col("e.ts").alias("ts")).agg(F.sum("e.n").alias("change"))


def warmup_start(books: DataFrame, depth: int = 400, on_snapshot: str = "replace") -> DataFrame:
    """(instId, start_ts): the first timestamp at which both sides have depth levels; instruments that never do are absent."""
    if depth <= 0:
        raise ValueError(f"depth must be positive, not {depth}")
    events = depth_events(books, on_snapshot)
    changed = events.groupBy("instId", "ts").agg(*(F.coalesce(F.sum(F.when(F.col("side") == s, F.col("change"))), F.lit(0)).alias(s) for s in ("ask", "bid")))
    asks = running(changed, ["instId"], "ts", "ask", "asks")
    both = running(asks, ["instId"], "ts", "bid", "bids")
    return both.where((F.col("asks") >= depth) & (F.col("bids") >= depth)).groupBy("instId").agg(F.min("ts").alias("start_ts"))


def staleness(books: DataFrame, start: int, end: int, step: int) -> DataFrame:
    """(instId, ts, last_update): the latest row's timestamp at or before each grid point, null before the first."""
    check_grid(start, end, step)
    k = F.greatest(F.ceil((F.col("timestamp") - start) / step), F.lit(0)).alias("k")
    latest = books.groupBy("instId", k).agg(F.max("timestamp").alias("at"))
    points = grid_points(books, start, end, step, by_side=False).withColumn("k", ((F.col("ts") - start) / step).cast("long"))
    joined = points.join(latest, ["instId", "k"], "left")
    return running(joined, ["instId"], "ts", "at", "last_update", width=step * 100_000, kind="max").select("instId", "ts", "last_update")


def stale_points(books: DataFrame, start: int, end: int, step: int, max_interval: int = 10_000) -> DataFrame:
    """Grid points whose last update is more than max_interval old, or that have none: (instId, ts, last_update)."""
    return staleness(books, start, end, step).where(F.col("last_update").isNull() | (F.col("ts") - F.col("last_update") > max_interval))


def late_rows(rows: DataFrame, width: int = 10_000) -> DataFrame:
    """Rows whose timestamp is before one that arrived earlier (by seq), with the latest before: max_before."""
    seen = running(rows, ["instId"], "seq", "timestamp", "max_before", width=width, kind="max", inclusive=False)
    return seen.where(F.col("timestamp") < F.col("max_before"))


def with_ranks(books: DataFrame) -> DataFrame:
    """books with rank: the number of its timestamp among its instrument's distinct ones, from 1."""
    return ranked(books, ["instId"], "timestamp", "rank")
