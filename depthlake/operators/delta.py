"""Delta encoding of consecutive full books."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import with_previous


def delta_encode(full: DataFrame) -> DataFrame:
    """(instId, timestamp, seq, side, price, size, numOrders, action) of full books (instId, timestamp, side, price, size, numOrders).

    The first timestamp is a snapshot. At each later one, levels of the book before that are gone come first, with size 0, then all
    levels of the book as updates. seq orders the rows of a timestamp: removals first, then by side and price.
    """
    times = with_previous(full.select("instId", "timestamp").distinct(), ["instId"], "timestamp", ["timestamp"])
    following = times.where("prev_timestamp is not null").select("instId", F.col("prev_timestamp").alias("timestamp"), F.col("timestamp").alias("next"))
    steps = times.join(following, ["instId", "timestamp"], "left").select("instId", "timestamp", F.col("prev_timestamp").isNull().alias("first"), "next")
    # a level is at once the present of its own book and the past of the next, so one aggregate finds what is gone
    none, level = F.lit(None).cast(full.select(F.struct("size", "numOrders").alias("x")).schema["x"].dataType), F.struct("size", "numOrders")
    own = F.struct(F.col("timestamp"), level.alias("now"), none.alias("past"), F.col("first"))
    past = F.struct(F.col("next").alias("timestamp"), none.alias("now"), level.alias("past"), F.lit(False).alias("first"))
    both = full.join(steps, ["instId", "timestamp"]).select("instId", "side", "price", F.explode(F.array(own, past)).alias("x")).select("instId", "side", "price", "x.*").where("timestamp is not null")
    levels = both.groupBy("instId", "timestamp", "side", "price").agg(F.max("now").alias("now"), F.max("past").alias("past"), F.bool_or("first").alias("first"))
    over = Window.partitionBy("instId", "timestamp").orderBy(F.col("now").isNotNull(), "side", "price")
    return levels.select(
        "instId", "timestamp", F.row_number().over(over).cast("long").alias("seq"), "side", "price",
        F.when(F.col("now").isNull(), F.lit(0.0)).otherwise(F.col("now.size")).alias("size"),
        F.when(F.col("now").isNull(), F.col("past.numOrders")).otherwise(F.col("now.numOrders")).alias("numOrders"),
        F.when(F.col("first"), "snapshot").otherwise("update").alias("action"),
    )
