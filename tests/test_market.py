"""Series, checksums, ingest, names, contracts, points and streams."""

import datetime
import json
import math
import pathlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from depthlake.functions import contracts
from depthlake.functions.names import inst_of, parse_file_name
from depthlake.operators import checksum, chunks, indicators, series
from depthlake.sources import datasets, ingest, points
from depthlake.sources.scratch import shared_dir
from depthlake.streaming import books as streams

from .fixtures import case
from .test_books import BOOKS, feed, replay

SERIES = "series_id string, ts bigint, val double"


def made(spark, *values, name="s", step=1):
    return spark.createDataFrame([(name, i * step, None if x is None else float(x)) for i, x in enumerate(values)], SERIES)


def vals(df):
    return [r.val for r in df.orderBy("ts").collect()]


def test_series_goldens(spark):
    assert vals(series.log_delta(made(spark, 1, 2, 4))) == pytest.approx([math.log(2)] * 2)
    assert vals(series.exp_smoothing(made(spark, 2, 4, 8), 0.5)) == [2, 3, 5.5]
    assert [r.val for r in series.last_n(made(spark, 9, 1, 2, 3), 3, "mean").collect()] == [2]
    assert [r.val for r in series.last_n(made(spark, 9, 1, 2, 3), 3, "var").collect()] == pytest.approx([2 / 3])
    gap = series.series_gap(made(spark, 1, math.nan, 3), made(spark, 5, math.nan))
    assert vals(gap) == [-4, None, 3]
    moved = series.price_change_intervals(made(spark, 100, 106, 106, step=60_000), 1, 0.05)
    assert [(r.start_minute, r.end_minute, r.val) for r in moved.collect()] == [(0, 1, pytest.approx(0.06))]


def test_series_guards(spark):
    s = made(spark, 1, 2)
    for call in (lambda: series.exp_smoothing(s, 1), lambda: series.last_n(s, 0, "mean"), lambda: series.rolling(s, 0, "mean")):
        with pytest.raises(ValueError):
            call()
    for call in (lambda: series.last_n(s, 3, "mean"), lambda: series.log_delta(made(spark, 1))):
        with pytest.raises(Exception, match="too few rows"):
            call().collect()
    holed = spark.createDataFrame([("s", m * 60_000, 1.0 + m) for m in (0, 1, 3, 4)], SERIES)
    with pytest.raises(Exception, match="a minute is missing"):
        series.price_change_intervals(holed, 1).collect()
    assert series.price_change_intervals(holed, 1, on_gap="skip").count() == 2
    assert [r.val for r in series.series_at(s, pd.Timestamp(1, unit="ms")).collect()] == [2]
    assert series.series_between(s, 0, 1).count() == 2
    with pytest.raises(TypeError):
        series.series_at(s, "0")


def test_scans_cross_blocks(spark):
    rng = random.Random(3)
    xs = [rng.random() + 1 for _ in range(205)]
    s, smooth = made(spark, *xs, step=1_000_000), []
    for x in xs:
        smooth.append(x if not smooth else 0.3 * x + 0.7 * smooth[-1])
    assert vals(series.exp_smoothing(s, 0.3, block=20)) == pytest.approx(smooth, abs=1e-12)
    assert vals(series.rolling(s, 7, "mean", block=20)) == pytest.approx([sum(xs[i - 6 : i + 1]) / 7 for i in range(6, 205)])
    assert vals(series.log_delta(s)) == pytest.approx([math.log(b / a) for a, b in zip(xs, xs[1:])])


def test_smoothing_of_many_blocks(spark):
    """Slow weights that reach over all blocks, fast ones that fade inside one, and series of one row and of whole blocks; a hot series is many groups."""
    rng = random.Random(6)
    long = {"hot": 500, "one": 1, "block": 20, "blocks": 40}
    rows = [(k, i * 1000, rng.random()) for k, n in long.items() for i in range(n)]
    s = spark.createDataFrame(rows, SERIES)
    for alpha in (0.001, 0.3, 0.999999):
        found = {}
        for r in series.exp_smoothing(s, alpha, block=20, width=7000).collect():
            found.setdefault(r.series_id, []).append((r.ts, r.val))
        for k in long:
            known = []
            for _, _, x in [r for r in rows if r[0] == k]:
                known.append(x if not known else alpha * x + (1 - alpha) * known[-1])
            assert [v for _, v in sorted(found[k])] == pytest.approx(known, abs=1e-12)
    assert series.exp_smoothing(spark.createDataFrame([], SERIES), 0.5).collect() == []


def test_smoothing_costs_little_per_block(spark, monkeypatch):
    """Blocks of few rows go through Python many at once, and what is stored of them is hardly more than a row each, whatever the levels."""
    sizes, store = [], series.stored
    monkeypatch.setattr(series, "stored", lambda df, name: sizes.append((found := store(df, name)).count()) or found)
    smooth = series.exp_smoothing(made(spark, *range(2000), step=100), 0.001, block=4, width=7000)
    assert sizes[0] == 2000 and 500 <= sum(sizes[1:]) <= 600
    assert "InPandas" not in smooth._jdf.queryExecution().toString()


def test_smoothing_by_levels_and_batches(spark, monkeypatch):
    """Blocks of blocks, batches that begin and end inside blocks, values that are null, NaN or infinite, and rows in no order."""
    monkeypatch.setattr(series, "BLOCK", 9)
    odd = {"null": (41, None), "nan": (300, math.nan), "infinite": (7, math.inf), "first": (0, None)}
    rng, long = random.Random(8), {"hot": 400, "one": 1, "null": 310, "nan": 310, "infinite": 3000, "first": 20}
    own = {k: [rng.random() * 100 - 50 for _ in range(n)] for k, n in long.items()}
    for k, (at, x) in odd.items():
        own[k][at] = x
    rows = [(k, i * 1000, x) for k, xs in own.items() for i, x in enumerate(xs)]
    s = spark.createDataFrame(rng.sample(rows, len(rows)), SERIES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for alpha, block in ((0.01, 1), (0.3, 10_000), (0.999999, 20)):
            found = {}
            for r in series.exp_smoothing(s, alpha, block=block, width=7000).collect():
                found.setdefault(r.series_id, []).append((r.ts, r.val))
            for k, xs in own.items():
                known = []
                for x in xs:
                    gone = x is None or math.isnan(x) or (known and known[-1] is None)
                    known.append(None if gone else x if not known else alpha * x + (1 - alpha) * known[-1])
                values = [v for _, v in sorted(found[k])]
                assert [v is None for v in values] == [v is None for v in known], (k, alpha, block)
                assert [v for v in values if v is not None] == pytest.approx([v for v in known if v is not None], abs=1e-11), (k, alpha, block)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_last_of_many(spark, monkeypatch):
    """Last values by one ranking, and above the limit from the last buckets alone."""
    rng = random.Random(7)
    rows = [(k, rng.randint(0, 10**6) * 100 + i, rng.random()) for k, n in (("a", 300), ("b", 40)) for i in range(n)]
    s = spark.createDataFrame(rows, SERIES)
    own = {k: [v for _, v in sorted((t, v) for kk, t, v in rows if kk == k)] for k in "ab"}
    for limit in (1000, 5):
        monkeypatch.setattr(series, "TOP", limit)
        found = {r.series_id: r.val for r in series.last_n(s, 30, "mean", width=1_000_000).collect()}
        assert found == {k: pytest.approx(sum(v[-30:]) / 30) for k, v in own.items()}
        with pytest.raises(Exception, match="too few rows"):
            series.last_n(s, 41, "var", width=1_000_000).collect()
    with pytest.raises(ValueError):
        series.last_n(s, 3, "median")
    plan = series.last_n(s, 3, "mean")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_checksum_text(spark):
    levels = [("bid", "3366.1", "7"), ("bid", "3366", "6"), ("ask", "3366.8", "9"), ("ask", "3368", "8")]
    rows = [("X", 5, i, s, p, z, 1, "snapshot") for i, (s, p, z) in enumerate(levels)]
    books = spark.createDataFrame(rows, BOOKS.replace("price double, size double", "price string, size string"))
    found = checksum.checksum_text(books).select("text", checksum.signed_crc32(F.col("text"))).collect()
    assert [tuple(r) for r in found] == [("3366.1:7:3366.8:9:3366:6:3368:8", -1881014294)]
    assert [r.text for r in checksum.replayed_text(books).collect()] == ["3366.1:7:3366.8:9:3366:6:3368:8"]


def test_checksums_by_parts_and_report(spark):
    rows = feed(4, 300)
    books = spark.createDataFrame(rows, BOOKS).withColumn("price", F.col("price").cast("string")).withColumn("size", F.col("size").cast("string"))
    texts = {}
    for ts, held in replay(rows).items():
        bids, asks = sorted((p for s, p in held if s == "bid"), reverse=True), sorted(p for s, p in held if s == "ask")
        texts[ts] = ":".join(f"{p}:{held[s, p][0]}" for i in range(25) for s, own in (("bid", bids), ("ask", asks)) for p in own[i : i + 1])
    for found in (checksum.checksum_text(books), checksum.replayed_text(books, 10)):
        assert {r.timestamp: r.text for r in found.collect()} == texts
    stated = books.join(checksum.checksum_text(books).select("timestamp", (checksum.signed_crc32(F.col("text")) + (F.col("timestamp") % 2)).alias("checksum")), "timestamp")
    counted = {r.timestamp for r in checksum.gap_sessions(checksum.timestamp_groups(books)).collect()}
    (report,) = checksum.checksum_report(stated, 10).collect()
    assert (report.passed, report.failed) == (sum(t % 2 == 0 for t in counted), sum(t % 2 for t in counted))


def test_best_levels():
    """Against a sort of the whole side after every change."""
    rng = random.Random(4)
    for sign in (1, -1):
        side, held = checksum.BestLevels(sign, 3), {}
        shown = side.best()
        for _ in range(3000):
            price, size = str(rng.randint(1, 12) / 2), rng.choice(["0", "0.0", "1", "2"])
            side.set(price, size)
            held.pop(price, None)
            if float(size):
                held[price] = size
            if rng.random() < 0.01:
                side.clear()
                held = {}
            known = [f"{p}:{held[p]}" for p in sorted(held, key=lambda p: sign * float(p))[:3]]
            if side.changed:
                shown = side.best()
            assert shown == known


def test_hot_timestamps_in_parts_of_rows(spark):
    """Parts are cut by rows between timestamps, whatever a timestamp holds; their texts are those of one part."""
    rows = [("X", 1, 0, "ask", "5", "1", 1, "snapshot")] + [("X", t, 100 * t + k, "ask", str(6 + k), str(t), 1, "update") for t in range(2, 30) for k in range(1 if t % 5 else 40)]
    books = spark.createDataFrame(rows, BOOKS.replace("price double, size double", "price string, size string"))
    one, many = (sorted(map(tuple, checksum.replayed_text(books, n).collect())) for n in (10_000, 8))
    assert one == many and len(one) == 29
    sizes = [r["rows"] for r in chunks.part_catalog(chunks.parts_by_rows(books, 8)).collect()]
    assert len(sizes) > 5 and max(sizes) <= 8 + 40 + 41


def counted_groups(groups, silence=60_000):
    """The rule as a loop: time since the last counted group."""
    last, waiting, out = 0, False, []
    for ts, action in groups:
        if ts - last > silence:
            waiting = True
        if waiting and action != "snapshot":
            continue
        waiting = False
        last = ts
        out.append(ts)
    return out


def test_gap_sessions(spark):
    known = [(100_000, "update"), (160_000, "snapshot"), (170_000, "update"), (240_001, "update"), (250_000, "update")]
    rng = random.Random(9)
    for groups in [known] + [[(t, rng.choice(["update", "update", "snapshot"])) for t in sorted(rng.sample(range(0, 2_000_000, 10_000), 40))] for _ in range(4)]:
        df = spark.createDataFrame([("X", t, a) for t, a in groups], "instId string, timestamp bigint, action string")
        assert sorted(r.timestamp for r in checksum.gap_sessions(df).collect()) == counted_groups(groups)
    assert counted_groups(known) == [160_000, 170_000]


def test_flatten_from_files(spark, tmp_path):
    payload = {"ts": "7", "checksum": -5, "asks": [["2.0", "1", "0", "3"], ["2.1", "4", "0", "1"]], "bids": [["1.9", "5", "0", "2"]]}
    doc = {"data": [{"arg": {"instId": "X"}, "action": "snapshot", "data": [payload]}, {"arg": {"instId": "X"}, "action": "update", "data": [payload | {"seqId": 9}]}]}
    (tmp_path / "OKX-Books-X-USD-400-1-2.json").write_text(json.dumps(doc))
    (tmp_path / "other.txt").write_text("no")
    rows = ingest.flatten_books(ingest.read_messages(spark, str(tmp_path), "books")).orderBy("seq").collect()
    assert [(r.side, r.price, r.numOrders, r.timestamp, r.seqId) for r in rows] == [(s, p, n, 7, q) for q in (None, 9) for s, p, n in (("ask", "2.0", 3), ("ask", "2.1", 1), ("bid", "1.9", 2))]
    (meta,) = ingest.find_files(spark, str(tmp_path), "Books").collect()
    assert (meta.dsID, meta.startTimestamp) == ("X-USD-400", "1")
    with pytest.raises(FileNotFoundError):
        ingest.find_files(spark, str(tmp_path), "Trades")
    bad = spark.createDataFrame([("f", 0, {"data": []})], "file string, n int, message struct<data:array<struct<instId:string,ts:string,tradeId:string,px:string,sz:string,side:string>>>")
    with pytest.raises(Exception, match="holds payloads"):
        ingest.flatten_trades(bad).collect()
    assert ingest.flatten_trades(bad, mode="quarantine").count() == 0 and ingest.guard_single_payload(bad).count() == 1
    missing = spark.createDataFrame([("f", 0, {"data": [{"instType": "S", "instId": "X", "uly": "U", "details": [{"side": "buy"}]}]})], "file string, n int, message struct<data:array<struct<instType:string,instId:string,uly:string,details:array<struct<side:string,posSide:string,bkPx:string,sz:string,bkLoss:string,ccy:string,ts:string>>>>>")
    with pytest.raises(Exception, match="no ts"):
        ingest.flatten_liquidations(missing).collect()
    with pytest.raises(Exception):
        ingest.conform(spark.createDataFrame([("123.0",)], "oi string"), "oi bigint").collect()


def test_names(spark):
    parse = lambda name: spark.createDataFrame([(name,)], "n string").select(parse_file_name(F.col("n")).alias("m")).select("m.*", inst_of(F.col("m.dsID")).alias("i")).first()
    assert tuple(parse("OKX-Books-1INCH-USD-SWAP-400-1689297329268-1689298999939.7z")) == ("OKX", "Books", "1INCH-USD-SWAP-400", "1689297329268", "1689298999939", "1INCH-USD-SWAP")
    with pytest.raises(Exception, match="not a data file name"):
        parse("a-b-c-d-e")


@pytest.mark.parametrize("day, now, alias", [("230707", "2023-07-03", "this_week"), ("230707", "2023-06-28", "next_week"), ("230630", "2023-05-01", "this_quarter"), ("230630", "2023-02-01", "next_quarter"), ("230707", "2023-07-08", None), ("230708", "2023-05-01", "other")])
def test_contract_alias(spark, day, now, alias):
    now_ms = int(pd.Timestamp(now, tz=contracts.ZONE).value // 1_000_000)
    assert spark.range(1).select(contracts.contract_alias(F.lit(now_ms), F.lit(day))).first()[0] == alias
    if alias is None:
        with pytest.raises(Exception, match="no contract"):
            spark.range(1).select(contracts.contract_alias(F.lit(now_ms), F.lit(day), mode="raise")).collect()


def test_datasets_and_points(spark, tmp_path):
    books = spark.createDataFrame(feed(5, 200), BOOKS)
    datasets.write_parts(chunks.chunked_dataset(books, 10, keep_tail=True), f"{tmp_path}/d")
    stamps = sorted({r.timestamp for r in books.collect()})
    a, b = stamps[25], stamps[47]
    got = datasets.read_books(spark, f"{tmp_path}/d", a, b)
    assert got.agg(F.min("timestamp")).first()[0] == stamps[20] and got.agg(F.max("timestamp")).first()[0] == b
    tv = indicators.total_value(case(spark, 1), 5, "ask", 0, 2000, 1000)
    points.write_points(points.to_points(tv, "TV", "OKX", "SWAP", "5"), f"{tmp_path}/p")
    read = points.read_points(spark, f"{tmp_path}/p", "TV", F.timestamp_millis(F.lit(2000)), 1)
    assert sorted(r.val for r in read.collect()) == pytest.approx([306.1, 306.1])
    assert points.cell_count(read).first().cells == 16
    tags, value, at = points.as_lines(read.orderBy("ts")).first().value.split(" ")
    assert (tags, at) == ("TV,exchange=OKX,instId=X,instType=SWAP,level=5,side=ask", "1000000000") and float(value[4:]) == pytest.approx(306.1)


def test_points_as_text(spark, tmp_path):
    odd = [("m,1", "O K=X", "I\\,level=9", None, "5", "a\\", datetime.datetime(2024, 1, 2, 3, 4, 5, 678901), 1.5e-7), ("m", "e", "i", "t", "", "bid", datetime.datetime(1969, 12, 31, 23, 59, 59, 999999), -3.0)]
    from depthlake.schemas import INDICATOR

    own = spark.createDataFrame(odd, INDICATOR)
    points.write_lines(own, f"{tmp_path}/lines")
    assert sorted(map(str, points.read_lines(spark, f"{tmp_path}/lines").collect())) == sorted(map(str, own.collect()))
    points.write_csv(own, f"{tmp_path}/csv")
    assert sorted(map(str, points.read_csv(spark, f"{tmp_path}/csv").collect())) == sorted(map(str, own.collect()))
    with pytest.raises(Exception, match="not a point"):
        points.from_lines(spark.createDataFrame([("m,exchange=x val=1",)], "value string")).collect()


def test_files_after_compaction(spark, tmp_path):
    """Sizes of the written files against the target: a large folder has as many as its bytes have targets, a small one has one; rows keep their order."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 10 < 8, "HOT").otherwise("A B").alias("instId"), (F.col("id") * 60_000).alias("timestamp"), F.col("id").alias("seq"), F.rand(3).alias("price"))
    rows.repartition(20).write.option("compression", "gzip").partitionBy("instId").parquet(f"{tmp_path}/in")
    before = {r.instId: r for r in datasets.file_sizes(spark, f"{tmp_path}/in").collect()}
    assert before["HOT"].files == 20
    for target, most in ((datasets.TARGET_BYTES, {"HOT": 1, "A B": 1}), (100_000, {k: -(-before[k].bytes // 100_000) for k in before})):
        out = f"{tmp_path}/out-{target}"
        datasets.compact(spark, f"{tmp_path}/in", out, target=target)
        assert {r.instId: r.files for r in datasets.file_sizes(spark, out).collect()} == most
        sizes = [f.stat().st_size for f in pathlib.Path(out).rglob("*.parquet")]
        assert max(sizes) <= 1.2 * target and (len(sizes) == 2 or min(sizes) > target / 4)
        found = datasets.with_places(datasets.read_ordered(spark, out), "instId")
        assert found.count() == 60_000 and found.groupBy("instId", "seq.file").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"), F.min("place").alias("p"), F.max("place").alias("q"), F.count("*").alias("n")).where("n <> q - p + 1").count() == 0
        ends = [r for r in found.groupBy("instId", "seq.file").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).orderBy("instId", "a").collect()]
        assert all(x.instId != y.instId or x.b < y.a for x, y in zip(ends, ends[1:]))


def test_flat_files_in_order(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("ab") + " c", rng.randint(0, 50), i) for i in range(2000)]
    datasets.write_flat(spark.createDataFrame(rows, "dsID string, timestamp long, n long").repartition(5), f"{tmp_path}/flat", "dsID", "timestamp", "n")
    found = datasets.with_places(datasets.read_ordered(spark, f"{tmp_path}/flat")).collect()
    for k in ("a c", "b c"):
        assert [(r.timestamp, r.n) for r in sorted((r for r in found if r.dsID == k), key=lambda r: r.place)] == sorted(r[1:] for r in rows if r[0] == k)
    assert all(f.name.endswith(".gz.parquet") for f in pathlib.Path(f"{tmp_path}/flat").rglob("*.parquet"))
    datasets.write_flat(spark.createDataFrame(rows, "dsID string, timestamp long, n long"), f"{tmp_path}/any")
    assert spark.read.parquet(f"{tmp_path}/any").count() == 2000


def test_manifest_of_files(spark):
    files = spark.createDataFrame([("d", f"/x/{i}", 40, str(90 + i)) for i in range(20)] + [("e", "/y", 500, "5")], "dsID string, filePath string, bytes long, startTimestamp string")
    found = {(r.dsID, r.ordinal): (r.filePath, r.bin) for r in ingest.file_manifest(files, 100, width=3).collect()}
    assert found == {("e", 1): ("/y", 0)} | {("d", i + 1): (f"/x/{i}", i * 40 // 100) for i in range(20)}


def shared(spark):
    """The tables in the shared folder."""
    folder = pathlib.Path(shared_dir(spark).removeprefix("file://"))
    return {x.name for x in folder.iterdir()} if folder.exists() else set()


def stored_by_key(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.STORE)


def run_book(spark, stream, path, **more):
    """The rows that stream_book writes."""
    stored_by_key(spark)
    streams.write_book(streams.stream_book(stream, **more), f"{path}/rows", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return streams.written(spark, f"{path}/rows").collect()


def test_streams_equal_the_batch(spark, tmp_path):
    rows = feed(6, 300)
    cut = sorted({r[1] for r in rows})
    bounds = [cut[len(cut) // 3], cut[2 * len(cut) // 3], cut[-1] + 1]
    for i, top in enumerate(bounds):
        low = bounds[i - 1] if i else -1
        spark.createDataFrame([r for r in rows if low <= r[1] < top], BOOKS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(BOOKS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
    found = run_book(spark, stream, f"{tmp_path}/book")
    states = replay(rows)
    assert {r.batch for r in found} == {0, 1, 2} and {r.kind for r in found} == {"book"}
    for batch in range(3):
        own = [r for r in found if r.batch == batch and r.lvl]
        at = max(t for t in states if t < bounds[batch])
        assert {(r.side, r.price): (r["size"], r.numOrders) for r in own} == states[at] and all(r.timestamp == at for r in own)
    kept = shared(spark)
    run = streams.stream_chunks(stream, f"{tmp_path}/chunks", 10, f"{tmp_path}/c2").trigger(availableNow=True).start()
    run.awaitTermination()
    before = shared(spark)
    streams.close_chunks(spark, f"{tmp_path}/chunks", run.lastProgress["batchId"], 10)
    assert shared(spark) == before and not any(x.startswith(("batch-", "told-", "parts-", "final-")) for x in before - kept)
    found = streams.closed_chunks(spark, f"{tmp_path}/chunks").select(*chunks.COLUMNS)
    known = chunks.chunked_dataset(spark.createDataFrame(rows, BOOKS), 10)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, known.select(*chunks.COLUMNS).collect()))


@pytest.mark.parametrize("lateness", [0, 40_000])
def test_streams_out_of_order(spark, tmp_path, lateness):
    """Rows that come within the lateness count as if they had come in time; the others are told, and change nothing."""
    rows, rng, waits, parts = feed(8, 240), random.Random(5), [], [[], [], [], []]
    times = sorted({r[1] for r in rows})
    for r in rows:
        home = min(3, times.index(r[1]) * 4 // len(times))
        parts[min(3, home + (rng.random() < 0.15) + (rng.random() < 0.05))].append(r)
    seen, kept, late = None, [], []
    for part in parts:
        for r in part:
            (late if seen is not None and r[1] < seen - lateness else kept).append(r)
        seen = max([seen or 0, *(r[1] for r in part)])
        rng.shuffle(part)
        spark.createDataFrame(part, BOOKS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(BOOKS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = run_book(spark, stream, f"{tmp_path}/book", lateness=lateness)
    kept.sort(key=lambda r: (r[1], r[2]))
    assert late and sorted(r.seq for r in found if r.kind == "late") == sorted(r[2] for r in late)
    assert {(r.side, r.price): (r["size"], r.numOrders) for r in found if r.kind == "book" and r.batch == 3 and r.lvl} == replay(kept)[kept[-1][1]]
    run = streams.stream_chunks(stream, f"{tmp_path}/chunks", 7, f"{tmp_path}/c2", lateness=lateness).trigger(availableNow=True).start()
    run.awaitTermination()
    streams.close_chunks(spark, f"{tmp_path}/chunks", run.lastProgress["batchId"], 7)
    own = streams.closed_chunks(spark, f"{tmp_path}/chunks").select(*chunks.COLUMNS)
    known = chunks.chunked_dataset(spark.createDataFrame(kept, BOOKS), 7)
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, known.select(*chunks.COLUMNS).collect()))
    assert sorted(r.seq for r in streams.late_chunk_rows(spark, f"{tmp_path}/chunks").collect()) == sorted(r[2] for r in late)


def test_late_rows_of_a_stream(spark, tmp_path):
    row = lambda t, price, size=1.0: ("X", t, t, "ask", price, size, 1, "update")
    for rows in ([row(10, 1.0)], [row(5, 2.0), row(20, 3.0)], [row(30, 1.0, 0.0), row(31, 3.0, 0.0)]):
        spark.createDataFrame(rows, BOOKS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(BOOKS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = run_book(spark, stream, f"{tmp_path}/drop", n_levels=3)
    assert sorted((r.batch, r.kind, r.timestamp, r.lvl, r.price) for r in found if r.price) == [(0, "book", 10, 1, 1.0), (1, "book", 20, 1, 1.0), (1, "book", 20, 2, 3.0), (1, "late", 5, None, 2.0)]
    assert [(r.batch, r.lvl, r.timestamp) for r in found if not r.price] == [(2, 0, 31)]
    assert streams.last_books(streams.written(spark, f"{tmp_path}/drop/rows")).collect() == []
    with pytest.raises(Exception, match="late rows of X"):
        run_book(spark, stream, f"{tmp_path}/raise", on_late="raise")
    for bad in ({"on_late": "keep"}, {"lateness": -1}):
        with pytest.raises(ValueError):
            streams.stream_book(stream, 3, **bad)
        with pytest.raises(ValueError):
            streams.stream_chunks(stream, "x", 3, "y", **bad)
