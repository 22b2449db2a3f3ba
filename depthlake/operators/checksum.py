"""Verification of feeds against the exchange's checksums."""

from __future__ import annotations

import bisect
import itertools
import operator
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import parts_of, timeline
from .scan import running, with_previous

#: Levels of a side in the checksum text, the longest silence of an uninterrupted feed, and rows of a part that one task replays.
LEVELS, SILENCE, PART_ROWS = 25, 60_000, 200_000


def signed_crc32(text: Column) -> Column:
    """CRC-32 as a signed 32-bit number, in a long."""
    value = F.crc32(text)
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value)


def gap_sessions(groups: DataFrame, silence: int = SILENCE) -> DataFrame:
    """The timestamp groups (instId, timestamp, action of the first row) that count: after a silence, nothing does until a snapshot.

    A session opened by a silence (the first one too, unless it starts within silence of 0) counts from its first snapshot on. While nothing counts,
    time since the last counted group runs on; since that silence has passed, this changes nothing.
    """
    ordered = with_previous(groups, ["instId"], "timestamp", ["timestamp"])
    opens = (F.col("timestamp") - F.coalesce("prev_timestamp", F.lit(0)) > silence).cast("int")
    numbered = running(ordered.withColumn("_opens", opens), ["instId"], "timestamp", "_opens", "session")
    snaps = numbered.where("action = 'snapshot'").groupBy("instId", "session").agg(F.min("timestamp").alias("_from"))
    counted = numbered.join(snaps, ["instId", "session"], "left").where("session = 0 or timestamp >= _from")
    return counted.select("instId", "timestamp", "action", "session")


def timestamp_groups(books: DataFrame) -> DataFrame:
    """(instId, timestamp, action): the action of each group's first row."""
    return books.groupBy("instId", "timestamp").agg(F.min_by("action", "seq").alias("action"))


class BestLevels:
    """One side of a book: prices in order, best first, placed by bisection, and what each level adds to the checksum text.

    changed tells whether one of the best levels has changed since it was last read.
    """

    def __init__(self, sign: int, levels: int):
        self.sign, self.levels = sign, levels
        self.clear()

    def clear(self) -> None:
        self.order: list[float] = []
        self.parts: dict[float, tuple[str, str]] = {}
        self.changed = True

    def set(self, price: str, size: str) -> None:
        """The level's new size; zero removes it, and one that is not there stays so."""
        own, part = self.sign * float(price), (price, size)
        if float(size) == 0:
            if self.parts.pop(own, None) is None:
                return
            at = bisect.bisect_left(self.order, own)
            del self.order[at]
        else:
            known = self.parts.get(own)
            self.parts[own] = part
            at = bisect.bisect_left(self.order, own)
            if known is None:
                self.order.insert(at, own)
            elif known == part:
                return
        self.changed |= at < self.levels

    def best(self) -> list[str]:
        self.changed = False
        return [":".join(self.parts[x]) for x in self.order[: self.levels]]


def part_texts(rows: Iterable[tuple], levels: int = LEVELS) -> Iterator[tuple]:
    """(timestamp, text) after each timestamp of a part's rows (timestamp, action, side, price, size), in order; a text is made anew only when a best level has changed."""
    sides = {"bid": BestLevels(-1, levels), "ask": BestLevels(1, levels)}
    text = ""
    for timestamp, group in itertools.groupby(rows, key=operator.itemgetter(0)):
        begins = True
        for _, action, side, price, size in group:
            if begins and action == "snapshot":
                for x in sides.values():
                    x.clear()
            begins = False
            sides[side].set(price, size)
        if any(x.changed for x in sides.values()):
            best = [x.best() for x in sides.values()]
            text = ":".join(x for pair in itertools.zip_longest(*best) for x in pair if x)
        yield timestamp, text


def replayed_text(books: DataFrame, rows: int = PART_ROWS, levels: int = LEVELS, on_missing: str = "drop") -> DataFrame:
    """(instId, timestamp, text): bid 1, ask 1, bid 2, ... of the best levels at each timestamp as price:size, from the first snapshot on (on_missing: see timeline); a shorter side is left out.

    price and size are the exchange's own text. A part of about so many rows replays from its own snapshot, in a task of its own.
    """

    def replay(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["timestamp", "seq"], na_position="first")
        found = list(part_texts(zip(part.timestamp.tolist(), part.action, part.side, part.price, part["size"]), levels))
        return pd.DataFrame({"instId": part.instId.iloc[0], "timestamp": [t for t, _ in found], "text": [x for _, x in found]})

    times = timeline(books, None, rows, "replace", on_missing)
    found = parts_of(books, times, keep_tail=True).groupBy("instId", "part").applyInPandas(replay, "instId string, timestamp bigint, text string")
    # a part that begins with an empty book has no row for its first timestamp
    return times.select("instId", "timestamp").join(found, ["instId", "timestamp"], "left").select("instId", "timestamp", F.coalesce("text", F.lit("")).alias("text"))


def checksum_text(books: DataFrame, levels: int = LEVELS, rows: int = PART_ROWS) -> DataFrame:
    """replayed_text of every timestamp, those before an instrument's first snapshot too: they start from an empty book."""
    return replayed_text(books, rows, levels, on_missing="start")


def replayed_checksums(books: DataFrame, rows: int = PART_ROWS, levels: int = LEVELS) -> DataFrame:
    """(instId, timestamp, text, checksum): the signed CRC-32 of replayed_text."""
    return replayed_text(books, rows, levels).withColumn("checksum", signed_crc32(F.col("text")))


def checksum_report(books: DataFrame, rows: int = PART_ROWS, levels: int = LEVELS) -> DataFrame:
    """(instId, passed, failed, ratio): counted groups whose replayed book has the checksum that the feed states, and not."""
    stated = books.groupBy("instId", "timestamp").agg(F.min_by("checksum", "seq").alias("checksum"))
    counted = gap_sessions(timestamp_groups(books)).join(stated, ["instId", "timestamp"])
    checked = counted.join(replayed_text(books, rows, levels), ["instId", "timestamp"], "left").withColumn("ok", F.coalesce(signed_crc32(F.col("text")) == F.col("checksum"), F.lit(False)))
    found = books.select("instId").distinct().join(checked, "instId", "left").groupBy("instId").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))
    return found.withColumn("ratio", F.when(F.col("passed") + F.col("failed") > 0, F.col("passed") / (F.col("passed") + F.col("failed"))))
