"""Market data derived from the given tables: the same rows in Spark and, as text, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The span of events: 2024-01-01 to 2024-01-30, by the hour.
START, END, STEP = 1_704_067_200_000, 1_706_572_800_000, 3_600_000
TEN_MINUTES = 600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ms() -> F.Column:
    # events.ts has no zone: milliseconds as if it were UTC, whatever the session's zone
    return F.expr("bigint(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000)")


def books_of(events: DataFrame) -> DataFrame:
    slot, ask = F.floor(_ms() / TEN_MINUTES).cast("long"), F.col("event_id") % 2 == 0
    level = F.floor("value").cast("long") % 20
    return events.select(
        F.concat(F.lit("INST-"), (F.col("user_id") % 4).cast("string")).alias("instId"),
        (slot * TEN_MINUTES).alias("timestamp"),
        F.col("event_id").alias("seq"),
        F.when(ask, "ask").otherwise("bid").alias("side"),
        F.when(ask, 101 + level).otherwise(99 - level).cast("double").alias("price"),
        F.when(F.col("event_type") == "error", 0.0).otherwise((1 + F.col("event_id") % 50) / 4).alias("size"),
        (1 + F.col("event_id") % 7).cast("long").alias("numOrders"),
        F.when(slot % 144 == 0, "snapshot").otherwise("update").alias("action"),
    )


def book_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books_of(table(spark, sf_dir, "events"))


BOOKS_SQL = """be AS (
  SELECT 'INST-' || (user_id % 4) AS "instId", (epoch_ns(ts) // 600000000000) * 600000 AS "timestamp", event_id AS seq,
         CASE WHEN event_id % 2 = 0 THEN 'ask' ELSE 'bid' END AS side,
         CAST(CASE WHEN event_id % 2 = 0 THEN 101 + CAST(floor(value) AS BIGINT) % 20 ELSE 99 - CAST(floor(value) AS BIGINT) % 20 END AS DOUBLE) AS price,
         CAST(CASE WHEN event_type = 'error' THEN 0 ELSE (1 + event_id % 50) / 4.0 END AS DOUBLE) AS size,
         CAST(1 + event_id % 7 AS BIGINT) AS "numOrders",
         CASE WHEN (epoch_ns(ts) // 600000000000) % 144 = 0 THEN 'snapshot' ELSE 'update' END AS action
  FROM events)"""

INTERVALS_SQL = (
    BOOKS_SQL
    + """, snaps AS (SELECT DISTINCT "instId", "timestamp" AS t FROM be WHERE action = 'snapshot'),
cleared AS (SELECT b.seq, min(s.t) AS clr FROM be b JOIN snaps s ON s."instId" = b."instId" AND s.t > b."timestamp" GROUP BY b.seq),
led AS (SELECT b.*, lead(b."timestamp") OVER (PARTITION BY b."instId", side, price ORDER BY b."timestamp", b.seq) AS nxt, clr FROM be b LEFT JOIN cleared USING (seq)),
iv AS (SELECT "instId", side, price, size, "numOrders", "timestamp" AS valid_from, least(coalesce(nxt, clr), coalesce(clr, nxt)) AS valid_to FROM led),
live AS (SELECT * FROM iv WHERE size > 0 AND (valid_to IS NULL OR valid_to > valid_from))"""
)

POINTS_SQL = f"""insts AS (SELECT DISTINCT "instId" FROM be),
points AS (SELECT "instId", side, ts FROM insts, (VALUES ('ask'), ('bid')) v(side), (SELECT unnest(generate_series({START}, {END}, {STEP})) AS ts) g)"""

GRID_SQL = (
    INTERVALS_SQL
    + ", "
    + POINTS_SQL
    + """, grid AS (
  SELECT p."instId", p.ts, p.side, row_number() OVER (PARTITION BY p."instId", p.ts, p.side ORDER BY CASE WHEN p.side = 'ask' THEN price ELSE -price END) AS lvl, price, size, "numOrders"
  FROM points p JOIN live l ON l."instId" = p."instId" AND l.side = p.side AND l.valid_from <= p.ts AND (l.valid_to IS NULL OR p.ts < l.valid_to))"""
)


#: Messages of a dump file, of all instruments.
DUMP = 5000


def write_dumps(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Trade messages as files path/OKX-Trades-<dataset>-<first>-<last>.json, each one object with so many messages at most."""
    m = messages(spark, sf_dir, "trades")
    first = F.floor(F.col("n") / DUMP) * DUMP
    name = F.concat_ws("-", F.lit("OKX-Trades"), F.get("message.data", 0).instId, F.lit("400"), first.cast("string"), (first + DUMP - 1).cast("string"))
    files = m.groupBy(name.alias("name")).agg(F.to_json(F.struct(F.collect_list("message").alias("data"))).alias("value"))
    files.write.partitionBy("name").text(f"{path}-unnamed")
    # Spark doesn't choose names of files: each gets that of its folder
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop(path))
    for found in files.globStatus(hadoop(f"{path}-unnamed/name=*/part-*")):
        files.rename(found.getPath(), hadoop(path, found.getPath().getParent().getName().removeprefix("name=") + ".json"))


#: Six slices of the events' span, in which a feed arrives, in milliseconds each; one row in so many comes three slices later.
SLICE, SLICES, DELAYED = 432_000_000, 6, 11


def arriving(books: DataFrame) -> DataFrame:
    """books with the slice in which each row arrives."""
    home = F.least(F.floor((F.col("timestamp") - START) / SLICE), F.lit(SLICES - 1)).cast("int")
    return books.withColumn("slice", F.when((F.col("seq") % DELAYED == 3) & (home + 3 < SLICES), home + 3).otherwise(home))


def arriving_feed(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """A stream of book_events as files that arrive slice by slice; a micro-batch has one file."""
    books = arriving(book_events(spark, sf_dir))
    for number in range(SLICES):
        books.where(F.col("slice") == number).drop("slice").write.mode("append").parquet(path)
    return spark.readStream.schema(books.drop("slice").schema).option("maxFilesPerTrigger", 1).parquet(path)


#: Late are the rows over a slice behind what had arrived before their own slice: lt. be has all others.
ARRIVING_SQL = (
    BOOKS_SQL.replace("be AS (", "ba AS (", 1)
    + f""", ah AS (SELECT *, least(("timestamp" - {START}) // {SLICE}, {SLICES - 1}) AS home FROM ba), ar AS (SELECT *, CASE WHEN seq % {DELAYED} = 3 AND home + 3 < {SLICES} THEN home + 3 ELSE home END AS slice FROM ah),
ms AS (SELECT "instId", slice, max("timestamp") AS m FROM ar GROUP BY 1, 2), sn0 AS (SELECT a."instId", a.slice, max(b.m) AS seen FROM ms a JOIN ms b ON b."instId" = a."instId" AND b.slice < a.slice GROUP BY 1, 2),
tl AS (SELECT ar.*, coalesce("timestamp" < seen - {SLICE}, false) AS late FROM ar LEFT JOIN sn0 ON sn0."instId" = ar."instId" AND sn0.slice = ar.slice),
be AS (SELECT * EXCLUDE (home, slice, late) FROM tl WHERE NOT late), lt AS (SELECT * EXCLUDE (home, slice, late) FROM tl WHERE late)"""
)


def series_of(events: DataFrame) -> DataFrame:
    """A series per kind of event: quarters, so that sums are exact; equal times are told apart by a millisecond's number."""
    return events.select(F.col("event_type").alias("series_id"), F.col("event_id").alias("ts"), ((F.floor(F.col("value") * 4) + 4) / 4).alias("val"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_of(table(spark, sf_dir, "events"))


SERIES_SQL = "ev AS (SELECT event_type AS series_id, event_id AS ts, (floor(value * 4) + 4) / 4 AS val FROM events)"


def price_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series per kind of event in real time, in hundredths of a day's minutes, so that minutes are dense."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_type").alias("series_id"), F.floor(_ms() / 60).cast("long").alias("ts"), ((F.floor("value") + 100) / 1).alias("val"))


PRICE_SQL = "ps AS (SELECT event_type AS series_id, epoch_ns(ts) // 60000000 AS ts, floor(value) + 100 AS val FROM events)"


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name per event: (name)."""
    n = F.col("event_id")
    source = F.when(n % 5 == 0, "Trades").otherwise("Books")
    ds = F.concat(F.lit("C"), (n % 7).cast("string"), F.lit("-USD-"), F.when(n % 3 == 0, F.lit("SWAP")).otherwise(F.lit("230630")), F.when(n % 2 == 0, F.lit("-400")).otherwise(F.lit("")))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("/dumps/OKX-"), source, F.lit("-"), ds, F.lit("-"), n.cast("string"), F.lit("-"), (n + 60).cast("string"), F.lit(".7z")).alias("name"))


NAMES_SQL = """nm AS (SELECT event_id AS n, CASE WHEN event_id % 5 = 0 THEN 'Trades' ELSE 'Books' END AS source,
  'C' || (event_id % 7) || '-USD-' || CASE WHEN event_id % 3 = 0 THEN 'SWAP' ELSE '230630' END || CASE WHEN event_id % 2 = 0 THEN '-400' ELSE '' END AS ds FROM events)"""


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, now_ms, day): an expiry 1 to 200 days after each event."""
    day = F.date_format(F.date_add(F.to_date("ts"), (F.col("event_id") % 200 + 1).cast("int")), "yyMMdd")
    return table(spark, sf_dir, "events").select("event_id", _ms().alias("now_ms"), day.alias("day"))


CONTRACTS_SQL = """ct AS (SELECT event_id, epoch_ns(ts) // 1000000 AS now_ms, CAST(ts AS DATE) + CAST(event_id % 200 + 1 AS INTEGER) AS d FROM events),
ca AS (SELECT *, epoch_ms(CAST(d AS TIMESTAMP) + INTERVAL 8 HOUR) - now_ms AS "left", (CAST(d AS DATE) - DATE '2022-12-30') % 91 = 0 AS cyc FROM ct)"""


def raw_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_events with prices and sizes as text and a stated checksum, that of the text in every third group and 0 in others."""
    books = book_events(spark, sf_dir)
    return books.withColumn("price", F.col("price").cast("string")).withColumn("size", F.col("size").cast("string"))


def messages(spark: SparkSession, sf_dir: str, channel: str) -> DataFrame:
    """(file, n, message) of a channel, written as JSON and read back by its schema."""
    from ..schemas import MESSAGES

    e, text = table(spark, sf_dir, "events"), lambda c: c.cast("string")
    n, inst = F.col("event_id"), F.concat(F.lit("INST-"), (F.col("user_id") % 4).cast("string"))
    ts, value, arg = text(_ms()).alias("ts"), text(F.floor("value")), F.struct(inst.alias("instId")).alias("arg")
    none = F.lit(None).cast("string")  # JSON leaves nulls out
    apart = lambda *names: [text(F.floor("value") + k).alias(x) for k, x in enumerate(names)]  # noqa: E731  so that no two columns can be mistaken
    shapes = {
        "trades": F.struct(F.array(F.struct(inst.alias("instId"), ts, text(n).alias("tradeId"), value.alias("px"), text(n % 50).alias("sz"), F.when(n % 2 == 0, "buy").otherwise("sell").alias("side"))).alias("data")),
        "tickers": F.struct(F.array(F.struct(F.lit("SWAP").alias("instType"), inst.alias("instId"), ts, *apart("last", "lastSz", "askPx", "askSz", "bidPx", "bidSz", "open24h", "high24h", "low24h", "volCcy24h", "vol24h", "sodUtc0", "sodUtc8"))).alias("data")),
        "open_interest": F.struct(F.array(F.struct(F.lit("SWAP").alias("instType"), inst.alias("instId"), ts, text(n * 3).alias("oi"), value.alias("oiCcy"))).alias("data")),
        "mark_price": F.struct(F.array(F.struct(F.lit("SWAP").alias("instType"), inst.alias("instId"), ts, value.alias("markPx"))).alias("data")),
        "liquidations": F.struct(F.array(F.struct(F.lit("SWAP").alias("instType"), inst.alias("instId"), F.col("event_type").alias("uly"), F.array(F.struct(F.lit("buy").alias("side"), value.alias("bkPx"), none.alias("sz"), ts), F.struct(none.alias("side"), none.alias("bkPx"), text(n).alias("sz"), ts)).alias("details"))).alias("data")),
        "index_tickers": F.struct(arg, F.array(F.struct(ts, *apart("idxPx", "high24h", "low24h", "open24h", "sodUtc0", "sodUtc8"))).alias("data")),
    }
    if channel == "books":
        b = raw_books(spark, sf_dir)
        levels = lambda s: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("seq", "price", "size", text(F.col("numOrders")).alias("o"))))), lambda x: F.array(x.price, x["size"], F.lit("0"), x.o))
        groups = b.groupBy("instId", "timestamp").agg(F.min_by("action", "seq").alias("action"), F.min("seq").alias("seqId"), levels("ask").alias("asks"), levels("bid").alias("bids"))
        shape = F.struct(F.struct("instId").alias("arg"), "action", F.array(F.struct(text(F.col("timestamp")).alias("ts"), F.crc32("instId").alias("checksum"), "seqId", "asks", "bids")).alias("data"))
        written = groups.select(F.col("instId").alias("file"), F.col("timestamp").alias("n"), F.to_json(shape).alias("j"))
    else:
        written = e.select(F.lit(channel).alias("file"), n.alias("n"), F.to_json(shapes[channel]).alias("j"))
    return written.select("file", "n", F.from_json("j", MESSAGES[channel]).alias("message"))

