"""Structured Streaming: an incremental order book, and chunks closed as they fill. Both keep late rows apart.

An instrument's frontier is the latest timestamp of earlier micro-batches less a lateness. Rows before it are late: they change nothing, and are written to a table of their own, or end the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.chunks import parts_of, timeline
from ..sources.scratch import cleared, stored

FEED = ["instId", "timestamp", "seq", "side", "price", "size", "numOrders", "action"]
#: What a book's stream gives: kind is book for a level after a micro-batch (lvl from 1 for the best, one row of lvl 0 for an empty book), or late for a late row.
OUT = "kind string, instId string, timestamp bigint, seq bigint, side string, lvl int, price double, size double, numOrders bigint, action string"
#: The state store that keeps state by key, which maps need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The largest timestamp of a state that has seen none.
NEVER = -(1 << 62)


def _rule(on_late: str, lateness: int) -> None:
    if on_late not in ("drop", "raise"):
        raise ValueError(f"on_late must be drop or raise, not {on_late}")
    if lateness < 0:
        raise ValueError(f"lateness must not be negative, not {lateness}")


class LevelBook(StatefulProcessor):
    """An instrument's book, as a map of levels: only levels that a micro-batch changes are written.

    Of a level's rows the last by (timestamp, seq) counts, and of an instrument's snapshots the last: levels set before it are out. So rows may come in any order, within a
    micro-batch or, up to the lateness, across; they are taken piece by piece, and no micro-batch is held whole. A timestamp is a snapshot if its first row by seq is one.
    """

    def __init__(self, n_levels: int | None, lateness: int, on_late: str):
        self.n_levels, self.lateness, self.on_late = n_levels, lateness, on_late

    def init(self, handle: StatefulProcessorHandle) -> None:
        # removed levels stay until nothing older than their removal can come
        self.levels = handle.getMapState("levels", "side string, price double", "timestamp bigint, seq bigint, size double, numOrders bigint")
        # the first row of each timestamp that may still get rows
        self.firsts = handle.getMapState("firsts", "timestamp bigint", "seq bigint, opens boolean")
        self.mark = handle.getValueState("mark", "seen bigint, cleared bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, cleared = self.mark.get() if self.mark.exists() else (NEVER, NEVER)
        frontier, newest = max(NEVER, seen - self.lateness), seen
        fresh: dict[tuple, tuple] = {}
        firsts: dict[int, tuple] = {}
        for piece in rows:
            late = piece[piece.timestamp < frontier]
            if len(late):
                if self.on_late == "raise":
                    raise ValueError(f"{len(late)} late rows of {key[0]}, the first at {late.timestamp.min()}, after {seen}")
                yield late.assign(kind="late", lvl=pd.array([None] * len(late), "Int32"))[OUT_COLUMNS]
                piece = piece[piece.timestamp >= frontier]
            if not len(piece):
                continue
            newest = max(newest, int(piece.timestamp.max()))
            ordered = piece.sort_values(["timestamp", "seq"])
            for r in ordered.drop_duplicates("timestamp")[["timestamp", "seq", "action"]].itertuples(index=False, name=None):
                firsts[r[0]] = min(firsts.get(r[0], (1 << 62, False)), (r[1], r[2] == "snapshot"))
            for side, price, *value in ordered.drop_duplicates(["side", "price"], keep="last")[["side", "price", "timestamp", "seq", "size", "numOrders"]].itertuples(index=False, name=None):
                fresh[side, price] = max(fresh.get((side, price), (NEVER,)), tuple(value))
        if not firsts:
            return
        frontier = newest - self.lateness
        for timestamp, own in firsts.items():
            known = tuple(self.firsts.getValue((timestamp,))) if self.firsts.containsKey((timestamp,)) else own
            own = min(own, known)
            if timestamp >= frontier:
                self.firsts.updateValue((timestamp,), (int(own[0]), bool(own[1])))
            if own[1]:
                cleared = max(cleared, timestamp)
        for (timestamp,) in [tuple(k) for k, _ in self.firsts.iterator()]:
            if timestamp < frontier:
                self.firsts.removeKey((timestamp,))
        book = {tuple(k): tuple(v) for k, v in self.levels.iterator()}
        for level, own in fresh.items():
            if own > book.get(level, (NEVER,)):
                book[level] = own
                self.levels.updateValue(level, (int(own[0]), int(own[1]), float(own[2]), int(own[3])))
        for level, (timestamp, _, size, _) in book.items():
            if timestamp < cleared or (not size and timestamp < frontier):
                self.levels.removeKey(level)
        self.mark.update((newest, cleared))
        standing = [(side, price, size, orders) for (side, price), (timestamp, _, size, orders) in book.items() if size and timestamp >= cleared]
        out = []
        for side, sign in (("ask", 1), ("bid", -1)):
            best = sorted((x for x in standing if x[0] == side), key=lambda x: sign * x[1])[: self.n_levels]
            out += [("book", key[0], newest, None, side, i + 1, price, size, orders, None) for i, (_, price, size, orders) in enumerate(best)]
        if not out:  # that the book is empty now
            out.append(("book", key[0], newest, None, None, 0, None, None, None, None))
        yield pd.DataFrame(out, columns=OUT_COLUMNS).astype({"seq": "Int64", "lvl": "Int32", "numOrders": "Int64"})

    def close(self) -> None:
        pass


OUT_COLUMNS = [x.split()[0] for x in OUT.split(", ")]


def stream_book(books: DataFrame, n_levels: int | None = None, lateness: int = 0, on_late: str = "drop") -> DataFrame:
    """(kind, ...), see OUT: the best n_levels levels (all by default) of each side after each micro-batch's rows of an instrument, and the late rows.

    The session's state store must be STORE. on_late: drop, which gives them as rows of kind late, or raise, which ends the query.
    """
    _rule(on_late, lateness)
    return books.select(*FEED).groupBy("instId").transformWithStateInPandas(LevelBook(n_levels, lateness, on_late), OUT, "update", "None")


def write_book(stream: DataFrame, path: str, checkpoint: str):
    """A writer of stream_book's rows: path/batch=<n>/kind=book and path/batch=<n>/kind=late. A batch that runs again overwrites its own folder."""

    def step(batch: DataFrame, number: int) -> None:
        # partitioned by kind, so one evaluation of the state gives both tables
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)


def written(spark: SparkSession, path: str) -> DataFrame:
    """What write_book wrote, with batch and kind."""
    return spark.read.schema(f"{OUT.partition(', ')[2]}, batch bigint, kind string").parquet(path)


def last_books(rows: DataFrame) -> DataFrame:
    """(instId, timestamp, side, lvl, price, size, numOrders): each instrument's book after the last micro-batch that had rows of it."""
    books = rows.where("kind = 'book'")
    last = books.groupBy("instId").agg(F.max("batch").alias("batch"))
    return books.join(last, ["instId", "batch"]).where("lvl > 0").select("instId", "timestamp", "side", "lvl", "price", "size", "numOrders")


def stream_chunks(books: DataFrame, path: str, chunk_size: int, checkpoint: str, lateness: int = 0, on_late: str = "drop"):
    """A query that keeps the rows still open and writes each chunk once no row of it can come; stop it with close_chunks.

    Every micro-batch is written once, and joins the rows left open by the one before. Chunks whose successor begins before the frontier are written to path/closed/<batch>; the rows from the last chunk's
    checkpoint on are left in path/open/<batch>; late rows go to path/late/<batch>. A batch that runs again overwrites its own folders.
    """
    _rule(on_late, lateness)

    def step(batch: DataFrame, number: int) -> None:
        with cleared(batch.sparkSession):
            close_batch(batch, number)

    def close_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = stored(batch.select(*FEED), "batch")
        newest = rows.groupBy("instId").agg(F.max("timestamp").alias("seen"))
        if number:
            seen = spark.read.parquet(f"{path}/seen/{number - 1}")
            newest = newest.unionByName(seen).groupBy("instId").agg(F.max("seen").alias("seen"))
            late = F.coalesce(F.col("timestamp") < F.col("seen") - lateness, F.lit(False))
            if on_late == "raise":
                late = F.when(late, F.raise_error(F.format_string("a late row of %s at %d, after %d", "instId", "timestamp", "seen")).cast("boolean")).otherwise(False)
            told = stored(rows.join(seen, "instId", "left").withColumn("late", late), "told")
            told.where("late").select(*FEED).write.mode("overwrite").parquet(f"{path}/late/{number}")
            rows = told.where("not late").select(*FEED).unionByName(spark.read.parquet(f"{path}/open/{number - 1}"))
        newest.write.mode("overwrite").parquet(f"{path}/seen/{number}")
        _close(rows, spark.read.parquet(f"{path}/seen/{number}"), path, number, chunk_size, lateness)

    return books.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def _close(rows: DataFrame, newest: DataFrame, path: str, number: int, chunk_size: int, lateness: int) -> None:
    """Writes the chunks of rows that are closed and the rows that stay open; newest: (instId, seen)."""
    times = timeline(rows, chunk_size, None, "replace", "drop")
    parts = stored(parts_of(rows, times, keep_tail=True), "parts")
    frontier = F.col("seen") - lateness
    # the last chunk that the frontier has reached stays open, with all after it
    begins = times.where("first").select("instId", "part", "timestamp").join(newest, "instId")
    final = begins.groupBy("instId").agg(F.coalesce(F.max(F.when(F.col("timestamp") <= frontier, F.col("part"))), F.lit(0)).alias("final"))
    final = stored(begins.join(final, "instId").where("part = final").select("instId", "final", F.col("timestamp").alias("begin")), "final")
    parts.join(final, "instId").where("part < final").drop("final", "begin").withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/closed/{number}")
    # the checkpoint of a chunk whose forerunner is closed has no seq: it comes before all other rows of its timestamp
    cut = final.where("final > 0")
    heads = parts.join(cut, "instId").where("part = final and timestamp = begin").select("instId", "timestamp", F.lit(-1).cast("long").alias("seq"), *FEED[3:])
    # the removal of a level that isn't there marks the first timestamp, should its book be empty
    marks = cut.select("instId", F.col("begin").alias("timestamp"), F.lit(-2).cast("long").alias("seq"), F.lit("ask").alias("side"), F.lit(0.0).alias("price"), F.lit(0.0).alias("size"), F.lit(0).cast("long").alias("numOrders"), F.lit("snapshot").alias("action"))
    # where nothing is closed, a snapshot may yet come before the first one: rows stay as they are
    left = rows.join(final, "instId", "left").join(newest, "instId")
    tails = left.where((F.coalesce("final", F.lit(0)) > 0) & (F.col("timestamp") > F.col("begin"))).select(*FEED)
    whole = left.where((F.coalesce("final", F.lit(0)) == 0) & ((F.col("timestamp") >= F.col("begin")) | (F.col("timestamp") >= frontier))).select(*FEED)
    heads.unionByName(tails).unionByName(marks).unionByName(whole).write.mode("overwrite").parquet(f"{path}/open/{number}")


def close_chunks(spark: SparkSession, path: str, number: int, chunk_size: int) -> None:
    """Flushes what the last micro-batch (its number) left open; a chunk of one timestamp is left out."""
    left = spark.read.parquet(f"{path}/open/{number}")
    with cleared(spark):
        parts = parts_of(left, timeline(left, chunk_size, None, "replace", "drop"))
        parts.withColumn("batch", F.lit(number + 1).cast("long")).write.mode("overwrite").parquet(f"{path}/closed/{number + 1}")


def closed_chunks(spark: SparkSession, path: str) -> DataFrame:
    """All closed chunks, numbered per instrument in order: (instId, part, ...)."""
    rows = spark.read.parquet(f"{path}/closed/*")
    firsts = rows.select("instId", "batch", "part").distinct()
    number = F.row_number().over(Window.partitionBy("instId").orderBy("batch", "part")) - 1
    return rows.join(firsts.withColumn("number", number.cast("long")), ["instId", "batch", "part"]).drop("batch", "part").withColumnRenamed("number", "part")


def late_chunk_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that came too late for their chunk, if a second micro-batch has run."""
    return spark.read.parquet(f"{path}/late/*")
