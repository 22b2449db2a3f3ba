"""Self-contained parts of long feeds: each begins with a synthetic snapshot, so a reader never replays from the origin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .book import LEVEL, with_ranks
from .scan import ranked, running, with_next

COLUMNS = ["instId", "part", "timestamp", "side", "price", "size", "numOrders", "action"]


def _first_snapshots(books: DataFrame, on_missing: str) -> DataFrame:
    """(instId, _first): the first snapshot row, by timestamp and seq."""
    if on_missing not in ("raise", "drop"):
        raise ValueError(f"on_missing must be raise or drop, not {on_missing}")
    firsts = books.groupBy("instId").agg(F.min(F.when(F.col("action") == "snapshot", F.struct("timestamp", "seq"))).alias("_first"))
    if on_missing == "raise":
        kind = firsts.schema["_first"].dataType
        firsts = firsts.withColumn("_first", F.coalesce("_first", F.raise_error(F.concat(F.lit("no snapshot row for "), "instId")).cast(kind)))
    return firsts


def trim_to_snapshot(books: DataFrame, on_missing: str = "raise") -> DataFrame:
    """Rows from each instrument's first snapshot row on. on_missing: raise for an instrument without one, or drop it."""
    return books.join(_first_snapshots(books, on_missing), "instId").where(F.struct("timestamp", "seq") >= F.col("_first")).drop("_first")


def split_by_ts(rows: DataFrame, size: int) -> DataFrame:
    """rows with chunk: size distinct timestamps of an instrument make one, in order."""
    if size < 1:
        raise ValueError(f"the chunk size must be positive, not {size}")
    return with_ranks(rows).withColumn("chunk", F.floor((F.col("rank") - 1) / size).cast("long")).drop("rank")


def timeline(books: DataFrame, chunk_size: int | None = None, rows: int | None = None, on_snapshot: str = "replace", on_missing: str = "raise") -> DataFrame:
    """(instId, timestamp, from_seq, part, first, head, cleared, last_part): a row for each distinct timestamp from the first snapshot on; a stored table, from one scan of books.

    part: of chunk_size distinct timestamps, or else of about so many rows, cut between timestamps. first: whether the timestamp begins its part. head: the first part whose
    beginning knows the timestamp's rows. cleared: the head of the next snapshot after it, null if none follows. Rows of a timestamp with a seq below from_seq come before the first snapshot.
    on_missing: raise for an instrument without a snapshot, drop it, or start every instrument at its first timestamp, with an empty book.
    """
    opens = F.min_by("action", "seq") == "snapshot" if on_snapshot == "replace" else F.lit(False)
    snap = F.min(F.when(F.col("action") == "snapshot", F.col("seq")))
    times = stored(books.groupBy("instId", "timestamp").agg(opens.alias("opens"), snap.alias("snap"), F.count(F.lit(1)).alias("n")), "times")
    known = times if on_missing == "start" else times.where("snap is not null")
    from_seq = F.lit(None).cast(times.schema["snap"].dataType) if on_missing == "start" else F.col("snap")
    firsts = known.groupBy("instId").agg(F.min_by(F.struct("timestamp", from_seq.alias("snap")), "timestamp").alias("_first"))
    if on_missing == "raise":
        firsts = times.select("instId").distinct().join(firsts, "instId", "left")
        firsts = firsts.withColumn("_first", F.coalesce("_first", F.raise_error(F.concat(F.lit("no snapshot row for "), "instId")).cast(firsts.schema["_first"].dataType)))
    first = F.col("timestamp") == F.col("_first.timestamp")
    kept = times.join(firsts, "instId").where(F.col("timestamp") >= F.col("_first.timestamp")).select("instId", "timestamp", "n", F.when(first, F.col("_first.snap")).alias("from_seq"), (F.col("opens") | first).alias("opens"))
    if rows is None:
        placed = ranked(kept, ["instId"], "timestamp", "rank", distinct=False).withColumn("part", F.floor((F.col("rank") - 1) / chunk_size).cast("long"))
        placed = placed.withColumn("first", (F.col("rank") - 1) % chunk_size == 0)
    else:
        before = running(kept, ["instId"], "timestamp", "n", "before", inclusive=False).withColumn("part", F.floor(F.coalesce("before", F.lit(0)) / rows).cast("long"))
        parts = before.groupBy("instId", "part").agg(F.min("timestamp").alias("_begin"))
        placed = before.join(parts, ["instId", "part"]).withColumn("first", F.col("timestamp") == F.col("_begin"))
    # a timestamp that begins its part is in that part's head, others in the next one's
    headed = placed.withColumn("head", F.when(F.col("first"), F.col("part")).otherwise(F.col("part") + 1))
    headed = stored(headed.select("instId", "timestamp", "from_seq", "part", "first", "head", "opens"), "headed")
    last = headed.groupBy("instId").agg(F.max(F.struct("timestamp", "part", "first")).alias("_l")).select("instId", F.col("_l.part").alias("last_part"), F.col("_l.first").alias("alone"))
    # the snapshot that each timestamp follows or is, the first one always, hands on the next one's head
    snaps = headed.where("opens").select("instId", "timestamp", "head")
    following = with_next(snaps, ["instId"], "timestamp", ["head"], "_next").select("instId", F.col("timestamp").alias("_at"), F.col("_next.head").alias("cleared"))
    held = running(headed.withColumn("_open", F.when(F.col("opens"), F.col("timestamp"))), ["instId"], "timestamp", "_open", "_at", kind="max").drop("_open", "opens")
    return stored(held.join(following, ["instId", "_at"]).join(last, "instId").drop("_at"), "timeline")


def parts_of(books: DataFrame, times: DataFrame, keep_tail: bool = False) -> DataFrame:
    """The parts of books by their timeline: the full book at each part's first timestamp as a snapshot, and the rows of its others as they are.

    The rows with their places are stored once. Of a level, the last row known to each head counts, one row for a level and part at most, so that no task has a level's history; it stands in the heads up to the next such row or snapshot.
    """
    last_part = F.col("last_part") - (F.lit(0) if keep_tail else F.col("alone").cast("int"))
    placed = books.join(times, ["instId", "timestamp"]).where("from_seq is null or seq >= from_seq").withColumn("last_part", last_part)
    rows = stored(placed.select("instId", "timestamp", "seq", "side", "price", "size", "numOrders", "action", "part", "first", "head", "cleared", "last_part"), "placed")
    last = rows.groupBy(*LEVEL, "head").agg(F.max_by(F.struct("size", "numOrders", "cleared", "last_part"), F.struct("timestamp", "seq")).alias("x")).select(*LEVEL, "head", "x.*")
    following = F.lead("head").over(Window.partitionBy(*LEVEL).orderBy("head"))
    until = F.least(following - 1, F.col("cleared") - 1, F.col("last_part"))
    standing = last.withColumn("until", until).where("cast(size as double) > 0 and head <= until")
    begins = times.where("first").select("instId", "part", "timestamp")
    heads = standing.select(*LEVEL, "size", "numOrders", F.explode(F.sequence("head", "until")).alias("part")).join(begins, ["instId", "part"])
    tails = rows.where(~F.col("first") & (F.col("part") <= F.col("last_part")))
    return heads.withColumn("action", F.lit("snapshot")).select(*COLUMNS, F.lit(None).cast(rows.schema["seq"].dataType).alias("seq")).union(tails.select(*COLUMNS, "seq"))


def chunked_dataset(books: DataFrame, chunk_size: int, keep_tail: bool = False, on_snapshot: str = "replace", on_missing: str = "raise") -> DataFrame:
    """Parts of chunk_size distinct timestamps, each beginning with the full book at its first one as a snapshot.

    A last part of one timestamp is left out unless keep_tail. books is scanned twice: for its timeline, and for its rows.
    """
    if chunk_size < 2:
        raise ValueError(f"chunk_size must be 2 or more, not {chunk_size}")
    _check(on_snapshot, on_missing)
    return parts_of(books, timeline(books, chunk_size, None, on_snapshot, on_missing), keep_tail)


def parts_by_rows(books: DataFrame, rows: int, on_snapshot: str = "replace", on_missing: str = "raise") -> DataFrame:
    """Parts of about so many rows, cut between timestamps: at most so many and those of one timestamp, besides the snapshot. The last one is kept, whatever its size."""
    if rows < 1:
        raise ValueError(f"the rows of a part must be positive, not {rows}")
    _check(on_snapshot, on_missing)
    return parts_of(books, timeline(books, None, rows, on_snapshot, on_missing), keep_tail=True)


def _check(on_snapshot: str, on_missing: str) -> None:
    if on_snapshot not in ("replace", "upsert"):
        raise ValueError(f"on_snapshot must be replace or upsert, not {on_snapshot}")
    if on_missing not in ("raise", "drop", "start"):
        raise ValueError(f"on_missing must be raise, drop or start, not {on_missing}")


def part_catalog(parts: DataFrame) -> DataFrame:
    """(instId, part, min_timestamp, max_timestamp, rows)."""
    return parts.groupBy("instId", "part").agg(F.min("timestamp").alias("min_timestamp"), F.max("timestamp").alias("max_timestamp"), F.count(F.lit(1)).alias("rows"))
