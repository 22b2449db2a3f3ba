"""Exact dedup by a minimal perfect hash over the distinct digests of a history.

The history's distinct digests are dealt to shards by their own leading bits. Each shard holds a minimal perfect hash (levels of
bitmaps; a key's place is the rank of its bit) and, slot by slot, the full digest, the winner's doc_id and the number of
rows. New digests, grouped beforehand so that a hot text is one row, look up their slot and compare all 32 bytes: a match
joins the historical group, anything else forms groups of its own.

Defined results: null text counts as empty; a null doc_id never wins unless its group has no other, and keep_id is then null;
of repeated rows (same doc_id and text) one is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import partitions, saved, text_of

INDEX_SCHEMA = "shard int, levels binary, sizes binary, digests binary, winners binary, named binary, counts binary"
#: Digests of a shard: 48 bytes a slot, so that a shard takes a few MB.
SHARD_ROWS = 60_000
#: What stands for a winner where the group has no doc_id; a flag tells it from that doc_id itself.
NO_ID = -(1 << 63)


def _mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    x = a + b * np.uint64(2 * level + 1)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = digests.view("<u8").reshape(-1, 4)
    return words[:, 1].copy(), words[:, 2].copy()


def build_hash(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels of a minimal perfect hash for distinct digests (n x 32 bytes): the bits of all levels, and each level's size.

    A key stays on the first level where no other key has its bit.
    """
    a, b = _words(digests)
    levels, sizes = [], []
    while len(a):
        size = max(64, int(1.3 * len(a)))
        at = (_mixed(a, b, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        sizes.append(size)
        left = ~alone[at]
        a, b = a[left], b[left]
    bits = np.concatenate(levels) if levels else np.zeros(0, bool)
    return bits, np.array(sizes, np.int64)


def find_slots(bits: np.ndarray, sizes: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Each digest's slot; -1 if its bits are on no level. A digest that was never built in may get any slot."""
    slots = np.full(len(digests), -1, np.int64)
    a, b = _words(digests)
    rank, base = np.cumsum(bits), 0
    open_ = np.arange(len(digests))
    for level, size in enumerate(sizes):
        if not len(open_):
            break
        at = base + (_mixed(a[open_], b[open_], level) % np.uint64(size)).astype(np.int64)
        hit = bits[at]
        slots[open_[hit]] = rank[at[hit]] - 1
        open_ = open_[~hit]
        base += int(size)
    return slots


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in column), np.uint8).reshape(-1, 32)


def _groups(digests: np.ndarray, winners: np.ndarray, named: np.ndarray, counts: np.ndarray, in_history: bool) -> pd.DataFrame:
    keep = pd.array(winners, "Int64")
    keep[~named] = pd.NA
    return pd.DataFrame({"digest": [x.tobytes() for x in digests], "keep_id": keep, "group_size": counts, "in_history": in_history})


def _build_shard(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(group.digest)
    bits, sizes = build_hash(digests)
    slots = find_slots(bits, sizes, digests)
    order = np.empty(len(slots), np.int64)
    order[slots] = np.arange(len(slots))
    row = (int(key[0]), np.packbits(bits).tobytes(), sizes.tobytes(), digests[order].tobytes(), group.winner.to_numpy(np.int64)[order].tobytes(), group.named.to_numpy(bool)[order].tobytes(), group.n.to_numpy(np.int64)[order].tobytes())
    return pd.DataFrame([row], columns=["shard", "levels", "sizes", "digests", "winners", "named", "counts"])


def _probe_shard(index: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """The groups of a shard: one row per historical slot, with the new rows it gained, and one per new nonmember."""
    out = []
    slots = np.full(len(new), -1, np.int64)
    digests = _matrix(new.digest)
    ids, named, counts = new.winner.to_numpy(np.int64), new.named.to_numpy(bool), new.n.to_numpy(np.int64)
    if len(index):
        row = index.iloc[0]
        held = np.frombuffer(row.digests, np.uint8).reshape(-1, 32)
        sizes = np.frombuffer(row.sizes, np.int64)
        bits = np.unpackbits(np.frombuffer(row.levels, np.uint8))[: int(sizes.sum())].astype(bool)
        winners, known, n = (np.frombuffer(x, t).copy() for x, t in ((row.winners, np.int64), (row.named, bool), (row.counts, np.int64)))
        slots = find_slots(bits, sizes, digests)
        at = np.flatnonzero(slots >= 0)
        slots[at[(held[slots[at]] != digests[at]).any(axis=1)]] = -1  # not this digest byte by byte
        member = slots >= 0
        np.maximum.at(winners, slots[member], ids[member])
        np.logical_or.at(known, slots[member], named[member])
        np.add.at(n, slots[member], counts[member])
        out.append(_groups(held, winners, known, n, True))
    rest = slots < 0
    out.append(_groups(digests[rest], ids[rest], named[rest], counts[rest], False))
    return pd.concat([x for x in out if len(x)] or out[:1], ignore_index=True)


def digests_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text_of(), 256)).alias("digest"))


def _distinct(digests: DataFrame, shard: Column) -> DataFrame:
    # no nulls: pandas would make a column that has one a column of doubles
    winner = F.max("doc_id")
    return digests.groupBy("digest").agg(F.coalesce(winner, F.lit(NO_ID)).alias("winner"), winner.isNotNull().alias("named"), F.count(F.lit(1)).alias("n")).withColumn("shard", shard)


def _shard(n: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(n)).cast("int")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index of a table (digest, doc_id), one row per shard."""
    return _distinct(history, _shard(shards)).groupBy("shard").applyInPandas(_build_shard, INDEX_SCHEMA)


def look_up(index: DataFrame, batch: DataFrame, shards: int) -> DataFrame:
    """Groups (digest, keep_id, group_size, in_history) of the history and a batch (digest, doc_id) together."""
    new = _distinct(batch, _shard(shards))
    return index.groupBy("shard").cogroup(new.groupBy("shard")).applyInPandas(_probe_shard, "digest binary, keep_id long, group_size long, in_history boolean")


def duplicate_groups(digests: DataFrame) -> DataFrame:
    """Groups of equal digests of a table (doc_id, digest): the lower half of the range of doc_id is the history, the rest looks itself up in it."""
    low, high, rows = digests.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    middle = 0 if low is None else (low + high) // 2
    shards = max(partitions(digests.sparkSession), -(-rows // SHARD_ROWS))
    index = saved(build_index(digests.where(F.col("doc_id") <= middle), shards), "digest-index")
    return look_up(index, digests.where(~F.coalesce(F.col("doc_id") <= middle, F.lit(False))), shards)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, in_history."""
    # rows get a number, so that of repeated ones the first is found by an aggregate: a window would keep Spark from splitting a hot group
    digests = saved(digests_of(docs).withColumn("row", F.monotonically_increasing_id()), "digests")
    firsts = digests.groupBy("digest", "doc_id").agg(F.min("row").alias("first"))
    groups = duplicate_groups(digests.drop("row")).alias("g")
    winners = groups.join(firsts.alias("f"), (F.col("g.digest") == F.col("f.digest")) & F.col("g.keep_id").eqNullSafe(F.col("f.doc_id"))).select("g.*", "first")
    return digests.join(winners, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("first")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "in_history"
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns."""
    place = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("place")
    digests = saved(digests_of(docs), "digests")
    winners = duplicate_groups(digests).select("digest", place("keep_id"))
    rows = docs.select(F.unhex(F.sha2(text_of(), 256)).alias("digest"), F.struct("*").alias("row"))
    # repeated rows become one before the shuffle, as far as a task holds them
    rows = rows.withColumn("place", F.coalesce(F.col("row.doc_id").cast("long").cast("string"), F.lit(""))).dropDuplicates(["digest", "place"])
    return rows.join(winners.hint("merge"), ["digest", "place"], "left_semi").select("row.*")
