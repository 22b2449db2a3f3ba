"""Books, indicators and parts against known results and a plain replay."""

import random

import pytest
from pyspark.sql import functions as F

from depthlake.operators import book, chunks, delta, indicators

from .fixtures import CASE2, case, full_books, wave

BOOKS = "instId string, timestamp bigint, seq bigint, side string, price double, size double, numOrders bigint, action string"


def values(df):
    return [r.val for r in df.orderBy("ts").collect()]


@pytest.mark.parametrize(
    "metric, number, n, ask, bid",
    [
        (indicators.total_amount, 1, 5, [1.5, 3.0, 3.0], [1.5, 1.5, 8.7]),
        (indicators.total_amount, 2, 4, [1.4, 2.5, 2.5], [1.4, 1.0, 1.1]),
        (indicators.total_amount, 3, 4, [1.4, 2.5, 2.5, 2.5, 1.5], [1.4, 1.0, 1.1, 1.1, 0.8]),
        (indicators.total_value, 1, 5, [152, 306.1, 306.1], [146.5, 146.5, 848.5]),
        (indicators.total_value, 2, 4, [141.6, 254.1, 254.1], [137, 97, 107.3]),
        (indicators.total_value, 3, 4, [141.6, 254.1, 254.1, 254.1, 153.2], [137, 97, 107.3, 107.3, 78.05]),
        (indicators.mean_price, 1, 5, [102, 102, 102], [97, 97, 97]),
        (indicators.mean_price, 2, 4, [101.5] * 3, [97.5, 96.5, 97.5]),
        (indicators.mean_price, 3, 4, [101.5] * 4 + [101.75], [97.5, 96.5, 97.5, 97.5, 97.875]),
        (indicators.weighted_price, 1, 5, [101.33333333, 102.03333333, 102.03333333], [97.66666667, 97.66666667, 97.52873563]),
        (indicators.weighted_price, 2, 4, [101.14285714, 101.64, 101.64], [97.85714286, 97, 97.54545455]),
        (indicators.weighted_price, 3, 4, [101.14285714] + [101.64] * 3 + [102.13333333], [97.85714286, 97, 97.54545455, 97.54545455, 97.5625]),
    ],
)
def test_indicators(spark, metric, number, n, ask, bid):
    books = case(spark, number)
    for side, known in (("ask", ask), ("bid", bid)):
        assert values(metric(books, n, side, 0, 1000 * (len(known) - 1), 1000)) == pytest.approx(known, abs=1e-8)


@pytest.mark.parametrize("number, ask, bid", [(1, [5, 0], [0, 5]), (2, [6, 1], [5, 5]), (3, [6, 1, 0, 4], [5, 5, 0, 3])])
def test_level_changes(spark, number, ask, bid):
    books = case(spark, number)
    for side, known in (("ask", ask), ("bid", bid), ("total", [a + b for a, b in zip(ask, bid)])):
        assert values(indicators.level_changes(books, side, 1000, 1000 * len(known), 1000)) == known


@pytest.mark.parametrize("name, end, odd", [("sine", 149_000, {}), ("triangle", 149_000, {}), ("const", 300_000, None), ("gaussian", 252_000, {231_000: 0, 243_000: 0, 252_000: 0})])
def test_level_changes_of_waves(spark, name, end, odd):
    books = delta.delta_encode(full_books(spark, wave(name)))
    found = {r.ts: r.val for r in indicators.level_changes(books, "total", 1000, end, 1000).collect()}
    assert found == {ts: 0 if odd is None else odd.get(ts, 10) for ts in range(1000, end + 1, 1000)}


def test_level_changes_of_a_square_wave(spark):
    books = delta.delta_encode(full_books(spark, wave("square")))
    found = {r.ts: r.val for r in indicators.level_changes(books, "total", 1000, 501_000, 1000).collect()}
    assert [found[t] for t in (1000, 2000, 3000, 4000, 168_000, 334_000, 501_000)] == [0] * 7
    assert [found[t] for t in (167_000, 333_000, 500_000)] == [10] * 3


def test_mid_price_and_depth(spark):
    books = case(spark, 1)
    assert [r.mid for r in indicators.mid_price(books, 0, 2000, 1000).orderBy("ts").collect()] == [99.5] * 3
    assert [r.mid for r in indicators.mid_price(books, 500, 1600, 1000).orderBy("ts").collect()] == [99.5] * 2
    assert {r.depth for r in indicators.depth_by_ts(books, 0, 2000, 1000).collect()} == {5}
    early = indicators.depth_by_ts(books.where("timestamp > 0"), 0, 1000, 1000).orderBy("ts", "side").collect()
    assert [r.depth for r in early][:2] == [0, 0]


def test_bad_arguments(spark):
    books = case(spark, 1)
    with pytest.raises(Exception, match="fewer than 6 levels"):
        indicators.total_value(books, 6, "ask", 0, 2000, 1000).collect()
    assert values(indicators.total_value(books, 6, "ask", 0, 2000, 1000, on_shallow="null")) == [None] * 3
    for args in ((5, "ask", 500, 2000, 1000), (0, "ask", 0, 2000, 1000), (5, "x", 0, 2000, 1000)):
        with pytest.raises(ValueError):
            indicators.total_value(books, *args)
    with pytest.raises(ValueError):
        chunks.chunked_dataset(books, 1)


def test_delta_encoding_is_undone_by_the_book(spark):
    full = full_books(spark, CASE2)
    rows = delta.delta_encode(full)
    times = full.select("instId", F.col("timestamp").alias("ts")).distinct()
    again = book.book_at(rows, times).select("instId", F.col("ts").alias("timestamp"), "side", "price", "size", "numOrders")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, full.select(again.columns).collect()))
    gone = [(r.timestamp, r.side, r.price, r.numOrders) for r in rows.where("size = 0").collect()]
    assert sorted(gone) == [(1000, "bid", 99.0, 2), (2000, "ask", 105.0, 1)]


def feed(seed, n=600):
    rng, rows, ts = random.Random(seed), [], 0
    for seq in range(n):
        new = rng.random() < 0.6
        ts += rng.choice([1, 7, 5_000_000]) * new
        action = rows[-1][7] if rows and not new else ("snapshot" if not rows or rng.random() < 0.05 else "update")
        side = rng.choice(["ask", "bid"])
        price = float(rng.randint(101, 112) if side == "ask" else rng.randint(88, 99))
        rows.append((f"I{seed}", ts, seq, side, price, rng.choice([0.0, 0.25, 1.5, 3.0]), rng.randint(1, 4), action))
    return rows


def replay(rows):
    """The book after each timestamp."""
    states, held, last = {}, {}, None
    for _, ts, _, side, price, size, orders, action in rows:
        if ts != last and action == "snapshot":
            held = {}
        last = ts
        held.pop((side, price), None)
        if size:
            held[side, price] = (size, orders)
        states[ts] = dict(held)
    return states


@pytest.mark.parametrize("seed", [1, 2])
def test_intervals_equal_a_replay(spark, seed):
    rows = feed(seed)
    books, states = spark.createDataFrame(rows, BOOKS), replay(rows)
    times = spark.createDataFrame([(f"I{seed}", t) for t in states], "instId string, ts bigint")
    found = {t: {} for t in states}
    for r in book.book_at(books, times).collect():
        found[r.ts][r.side, r.price] = (r["size"], r.numOrders)
    assert found == states


def test_parts_replay_to_the_same_books(spark):
    rows = feed(3)
    books, states = spark.createDataFrame(rows, BOOKS), replay(rows)
    for size in (2, 7, 50):
        parts = chunks.chunked_dataset(books, size, keep_tail=True).collect()
        for number in {r.part for r in parts}:
            own = sorted((r for r in parts if r.part == number), key=lambda r: (r.timestamp, -1 if r.seq is None else r.seq))
            again = replay([(r.instId, r.timestamp, r.seq, r.side, r.price, r["size"], r.numOrders, r.action) for r in own])
            assert all(again[t] == states[t] for t in again if states[t] or t in again)
        stamps = sorted(states)
        catalog = {r.part: (r.min_timestamp, r.max_timestamp) for r in chunks.part_catalog(chunks.chunked_dataset(books, size, keep_tail=True)).collect()}
        for number, (low, high) in catalog.items():
            assert low >= stamps[number * size] and high <= stamps[min(len(stamps), (number + 1) * size) - 1]


F1 = [(2.0, 0.1, 10, "bid"), (2.1, 1.1, 11, "bid"), (2.2, 2.1, 12, "bid"), (2.3, 3.1, 13, "bid"), (2.4, 4.1, 14, "bid"), (2.5, 5.1, 15, "ask"), (2.6, 6.1, 16, "ask"), (2.7, 7.1, 17, "ask"), (2.8, 8.1, 18, "ask"), (2.9, 9.1, 19, "ask")]
LATER = [
    (2, 2.3, 3.6, 7, "bid", "update"), (2, 2.56, 6.51, 16, "ask", "update"), (2, 2.1, 0.0, 0, "bid", "update"),
    (3, 2.3, 0.0, 0, "bid", "update"), (3, 2.4, 9.51, 14, "bid", "update"), (3, 2.5, 1.36, 4, "ask", "update"), (3, 2.6, 3.64, 7, "ask", "update"),
    (4, 2.7, 6.1, 6, "ask", "update"), (4, 2.8, 1.1, 1, "ask", "update"), (4, 2.9, 0.0, 0, "ask", "update"),
    (5, 2.2, 3.3, 7, "bid", "update"), (5, 2.7, 7.6, 2, "ask", "update"),
    (6, 2.0, 0.0, 0, "bid", "update"), (6, 2.8, 4.9, 2, "ask", "update"),
    (7, 2.2, 1.1, 1, "bid", "snapshot"), (7, 2.7, 0.0, 0, "ask", "update"),
]


@pytest.mark.parametrize("on_snapshot", ["replace", "upsert"])
def test_chunked_dataset(spark, on_snapshot):
    rows = [("X", 1, 0, s, p, z, n, "snapshot") for p, z, n, s in F1] + [("X", t, 0, s, p, z, n, a) for t, p, z, n, s, a in LATER]
    rows = [(i, t, k, *rest) for k, (i, t, _, *rest) in enumerate(rows)]
    parts = chunks.chunked_dataset(spark.createDataFrame(rows, BOOKS), 2, on_snapshot=on_snapshot)
    assert sorted(map(tuple, chunks.part_catalog(parts).select("part", "min_timestamp", "max_timestamp").collect())) == [(0, 1, 2), (1, 3, 4), (2, 5, 6)]
    found = parts.collect()
    heads = {p: sorted((r.side, r.price, r["size"], r.numOrders) for r in found if r.part == p and r.timestamp == t) for p, t in ((1, 3), (2, 5))}
    assert heads[1] == [("ask", 2.5, 1.36, 4), ("ask", 2.56, 6.51, 16), ("ask", 2.6, 3.64, 7), ("ask", 2.7, 7.1, 17), ("ask", 2.8, 8.1, 18), ("ask", 2.9, 9.1, 19), ("bid", 2.0, 0.1, 10), ("bid", 2.2, 2.1, 12), ("bid", 2.4, 9.51, 14)]
    assert heads[2] == [("ask", 2.5, 1.36, 4), ("ask", 2.56, 6.51, 16), ("ask", 2.6, 3.64, 7), ("ask", 2.7, 7.6, 2), ("ask", 2.8, 1.1, 1), ("bid", 2.0, 0.1, 10), ("bid", 2.2, 3.3, 7), ("bid", 2.4, 9.51, 14)]
    assert all(r.action == "snapshot" for r in found if r.timestamp in (1, 3, 5)) and sum(r.part == 2 and r.timestamp == 6 for r in found) == 2


@pytest.mark.parametrize("stamps, size, known", [([1, 2, 2, 5, 6, 8, 10, 11, 12], 2, [[1, 2, 2], [5, 6], [8, 10], [11, 12]]), ([], 2, []), ([4], 2, [[4]]), ([3, 3, 3], 2, [[3, 3, 3]])])
def test_split_by_ts(spark, stamps, size, known):
    rows = spark.createDataFrame([("X", t) for t in stamps], "instId string, timestamp bigint")
    found: dict = {}
    for r in chunks.split_by_ts(rows, size).collect():
        found.setdefault(r.chunk, []).append(r.timestamp)
    assert [sorted(found[k]) for k in sorted(found)] == known


def test_split_of_many(spark):
    rows = spark.range(10_000).select(F.lit("X").alias("instId"), (F.col("id") * 60_000).alias("timestamp"))
    assert [r["count"] for r in chunks.split_by_ts(rows, 100).groupBy("chunk").count().collect()] == [100] * 100


def test_trim_warmup_stale_late(spark):
    books = spark.createDataFrame([("X", 1, 1, "ask", 5.0, 1.0, 1, "update"), ("X", 2, 2, "ask", 6.0, 1.0, 1, "snapshot"), ("X", 2, 3, "bid", 4.0, 1.0, 1, "snapshot"), ("X", 50_000, 4, "bid", 3.0, 1.0, 1, "update"), ("X", 40_000, 5, "ask", 7.0, 1.0, 1, "update")], BOOKS)
    assert chunks.trim_to_snapshot(books).count() == 4
    with pytest.raises(Exception, match="no snapshot row"):
        chunks.trim_to_snapshot(books.where("seq = 1")).collect()
    assert chunks.trim_to_snapshot(books.where("seq = 1"), on_missing="drop").count() == 0
    assert [tuple(r) for r in book.warmup_start(books, 2).collect()] == [("X", 50_000)]
    assert book.warmup_start(books, 3).count() == 0
    assert [(r.ts, r.last_update) for r in book.stale_points(books, 0, 60_000, 20_000).orderBy("ts").collect()] == [(0, None), (20_000, 2)]
    assert [(r.seq, r.max_before) for r in book.late_rows(books).collect()] == [(5, 50_000)]


def test_empty_books(spark):
    books = spark.createDataFrame([], BOOKS)
    assert indicators.total_value(books, 5, "ask", 0, 2000, 1000).collect() == []
    assert chunks.chunked_dataset(books, 2).collect() == [] and book.level_intervals(books).collect() == []


def test_staleness_of_indicators(spark):
    books = spark.createDataFrame([("X", t, s, "snapshot" if t == 0 else "update", side, p, 1.0, 1) for t, s, side, p in [(0, 0, "ask", 2.0), (0, 1, "bid", 1.0), (25_000, 2, "ask", 2.0)]], "instId string, timestamp long, seq long, action string, side string, price double, size double, numOrders long")
    found = lambda **more: [(r.ts, r.val) for r in indicators.total_amount(books, 1, "ask", 0, 40_000, 10_000, **more).orderBy("ts").collect()]
    whole = [(t, 1.0) for t in range(0, 40_001, 10_000)]
    assert found() == found(max_interval=10_000, on_stale="keep") == found(max_interval=20_000) == whole
    assert found(max_interval=10_000, on_stale="null") == [(t, None if t in (20_000, 40_000) else v) for t, v in whole]
    with pytest.raises(Exception, match="no row of X for 10000 ms"):
        found(max_interval=10_000)
    for bad in ({"on_stale": "drop"}, {"max_interval": -1}):
        with pytest.raises(ValueError):
            found(**bad)


def test_a_hot_level_has_many_tasks(spark):
    """One level with nine tenths of all rows: what follows each row is found in buckets of time, by more than one task."""
    rows = spark.range(20_000).select(F.lit("X").alias("instId"), (F.col("id") * 60_000).alias("timestamp"), F.col("id").alias("seq"), F.lit("ask").alias("side"), F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(100).cast("double").alias("price"), F.lit(1.0).alias("size"), F.lit(1).cast("long").alias("numOrders"), F.when(F.col("id") == 0, "snapshot").otherwise("update").alias("action"))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        by_task = book.level_intervals(rows).where("price = 100").groupBy(F.spark_partition_id()).count().collect()
        assert len(by_task) == 8 and max(r["count"] for r in by_task) < 18_000 / 3
        found = sorted((r.valid_from, r.valid_to) for r in book.level_intervals(rows).where("price = 100").collect())
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")
        spark.conf.unset("spark.sql.adaptive.enabled")
    stamps = [i * 60_000 for i in range(20_000) if i % 10]
    assert found == list(zip(stamps, [*stamps[1:], None]))


def test_chunks_scan_their_input_twice(spark):
    """A count inside the input: once for the timeline, once for the rows, however many branches read them."""
    rows, seen = feed(5, 200), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    books = spark.createDataFrame(rows, BOOKS)
    parts = chunks.chunked_dataset(books.mapInArrow(counted, books.schema), 7, keep_tail=True).collect()
    assert seen.value == 2 * len(rows)
    assert sorted(map(str, parts)) == sorted(map(str, chunks.chunked_dataset(books, 7, keep_tail=True).collect()))
    with pytest.raises(ValueError):
        chunks.chunked_dataset(books, 7, on_missing="other")
