"""The registered market-data queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contracts as contract
from ..functions import names
from ..functions.names import inst_of
from ..operators import book, checksum, chunks, delta, indicators, series
from ..schemas import BOOKS_RAW
from ..sources import datasets, ingest, points
from ..sources.scratch import scratch
from ..streaming import books as streams
from . import views as v
from .views import BOOKS_SQL, CONTRACTS_SQL, END, GRID_SQL, INTERVALS_SQL, NAMES_SQL, POINTS_SQL, PRICE_SQL, SERIES_SQL, START, STEP

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SPAN = (START, END, STEP)
#: Levels of an indicator, distinct timestamps of a part.
N, CHUNK = 3, 50
#: Numbers of events in a bucket of a series, so that small tables have many buckets.
WIDTH = 80


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- books, grids and indicators


@query(f"WITH {INTERVALS_SQL} SELECT * FROM live")
def level_intervals(spark, sf_dir):
    return book.level_intervals(v.book_events(spark, sf_dir))


@query(f"WITH {GRID_SQL} SELECT * FROM grid")
def book_grid(spark, sf_dir):
    return book.book_grid(v.book_events(spark, sf_dir), *SPAN)


@query(f"WITH {GRID_SQL} SELECT * FROM grid WHERE lvl <= {N}")
def top_n_levels(spark, sf_dir):
    return book.book_grid(v.book_events(spark, sf_dir), *SPAN, n_levels=N)


def _metric(expression: str, side: str) -> str:
    return f"""WITH {GRID_SQL}, m AS (SELECT "instId", side, ts, {expression} AS val, count(*) AS n FROM grid WHERE lvl <= {N} GROUP BY ALL)
SELECT p."instId", p.side, p.ts, CASE WHEN n >= {N} THEN val END AS val FROM points p LEFT JOIN m USING ("instId", side, ts) WHERE '{side}' IN ('total', p.side)"""


@query(_metric("sum(size)", "ask"))
def ta(spark, sf_dir):
    return indicators.total_amount(v.book_events(spark, sf_dir), N, "ask", *SPAN, on_shallow="null")


@query(_metric("sum(price * size)", "total"))
def tv(spark, sf_dir):
    return indicators.total_value(v.book_events(spark, sf_dir), N, "total", *SPAN, on_shallow="null")


@query(_metric("avg(price)", "bid"))
def aap(spark, sf_dir):
    return indicators.mean_price(v.book_events(spark, sf_dir), N, "bid", *SPAN, on_shallow="null")


@query(_metric("sum(price * size) / sum(size)", "total"))
def abp(spark, sf_dir):
    return indicators.weighted_price(v.book_events(spark, sf_dir), N, "total", *SPAN, on_shallow="null")


@query(_metric("max(price) - min(price)", "total"))
def book_metric_spread(spark, sf_dir):
    """A new indicator as one expression: the price range of the best levels."""
    return indicators.book_metric(v.book_events(spark, sf_dir), F.max("price") - F.min("price"), N, "total", *SPAN, on_shallow="null")


# the book one step before the first point is needed too
_CHANGES = f"""WITH {GRID_SQL.replace(f"generate_series({START},", f"generate_series({START - STEP},")},
d AS (SELECT coalesce(a."instId", b."instId") AS "instId", coalesce(a.side, b.side) AS side, coalesce(a.ts, b.ts + {STEP}) AS ts, (a.price, a.size, a."numOrders") IS DISTINCT FROM (b.price, b.size, b."numOrders") AS x
  FROM grid a FULL JOIN grid b ON a."instId" = b."instId" AND a.side = b.side AND a.lvl = b.lvl AND a.ts = b.ts + {STEP}),
c AS (SELECT "instId", side, ts, count(*) FILTER (WHERE x) AS n FROM d GROUP BY ALL),
e AS (SELECT p."instId", p.side, p.ts, CAST(coalesce(n, 0) AS DOUBLE) AS val FROM points p LEFT JOIN c USING ("instId", side, ts) WHERE p.ts >= {START})"""


@query(f"{_CHANGES} SELECT * FROM e WHERE side = 'ask'")
def blcsi(spark, sf_dir):
    return indicators.level_changes(v.book_events(spark, sf_dir), "ask", *SPAN)


@query(f"""{_CHANGES} SELECT "instId", 'total' AS side, ts, sum(val) AS val FROM e GROUP BY ALL""")
def blcsi_total(spark, sf_dir):
    return indicators.level_changes(v.book_events(spark, sf_dir), "total", *SPAN)


@query(f"""WITH {GRID_SQL}, m AS (SELECT "instId", side, ts, count(*) AS n FROM grid GROUP BY ALL)
SELECT "instId", side, ts, coalesce(n, 0) AS depth FROM points LEFT JOIN m USING ("instId", side, ts)""")
def depth_by_ts(spark, sf_dir):
    return indicators.depth_by_ts(v.book_events(spark, sf_dir), *SPAN)


@query(f"""WITH {GRID_SQL}, m AS (SELECT "instId", ts, (max(price) FILTER (WHERE side = 'ask' AND lvl = 1) + max(price) FILTER (WHERE side = 'bid' AND lvl = 1)) / 2 AS mid FROM grid GROUP BY ALL)
SELECT "instId", ts, mid FROM (SELECT DISTINCT "instId", ts FROM points) LEFT JOIN m USING ("instId", ts)""")
def mid_price(spark, sf_dir):
    return indicators.mid_price(v.book_events(spark, sf_dir), *SPAN)


_AT = f"""cp AS (SELECT DISTINCT "instId", ("timestamp" // 86400000) * 86400000 + 43200000 AS ts FROM be)"""


@query(f"""WITH {INTERVALS_SQL}, {_AT} SELECT c."instId", c.ts, side, price, size, "numOrders" FROM cp c JOIN live l ON l."instId" = c."instId" AND valid_from <= ts AND (valid_to IS NULL OR ts < valid_to)""")
def book_checkpoint(spark, sf_dir):
    """The full book at noon of every day."""
    books = v.book_events(spark, sf_dir)
    noons = books.select("instId", (F.floor(F.col("timestamp") / 86_400_000) * 86_400_000 + 43_200_000).alias("ts")).distinct()
    return book.book_at(books, noons)


@query(f"""WITH {INTERVALS_SQL}, ev AS (SELECT "instId", side, valid_from AS ts, 1 AS n FROM live UNION ALL SELECT "instId", side, valid_to, -1 FROM live WHERE valid_to IS NOT NULL),
t AS (SELECT "instId", ts, sum(CASE WHEN side = 'ask' THEN n ELSE 0 END) AS a, sum(CASE WHEN side = 'bid' THEN n ELSE 0 END) AS b FROM ev GROUP BY ALL),
r AS (SELECT "instId", ts, sum(a) OVER w AS a, sum(b) OVER w AS b FROM t WINDOW w AS (PARTITION BY "instId" ORDER BY ts))
SELECT "instId", min(ts) AS start_ts FROM r WHERE a >= 10 AND b >= 10 GROUP BY "instId" """)
def warmup_start(spark, sf_dir):
    return book.warmup_start(v.book_events(spark, sf_dir), depth=10)


@query(f"""WITH {BOOKS_SQL}, insts AS (SELECT DISTINCT "instId" FROM be), g AS (SELECT "instId", ts FROM insts, (SELECT unnest(generate_series({START}, {END}, {STEP})) AS ts)),
l AS (SELECT g."instId", g.ts, (SELECT max("timestamp") FROM be WHERE be."instId" = g."instId" AND be."timestamp" <= g.ts) AS last_update FROM g)
SELECT * FROM l WHERE last_update IS NULL OR ts - last_update > 1200000""")
def stale_points(spark, sf_dir):
    return book.stale_points(v.book_events(spark, sf_dir), *SPAN, max_interval=1_200_000)


@query(f"""WITH {BOOKS_SQL}, ar AS (SELECT * REPLACE (seq + 3 * (seq % 5) AS seq) FROM be), r AS (SELECT *, max("timestamp") OVER (PARTITION BY "instId" ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS max_before FROM ar)
SELECT * FROM r WHERE "timestamp" < max_before""")
def late_rows(spark, sf_dir):
    """Late rows of a feed whose neighbours arrive out of order."""
    return book.late_rows(v.book_events(spark, sf_dir).withColumn("seq", F.col("seq") + 3 * (F.col("seq") % 5)))


# --- parts


_TRIMMED = f"""{BOOKS_SQL}, f AS (SELECT "instId", min(("timestamp", seq)) AS k FROM be WHERE action = 'snapshot' GROUP BY 1),
tr AS (SELECT be.* FROM be JOIN f USING ("instId") WHERE ("timestamp", seq) >= k)"""


@query(f"WITH {_TRIMMED} SELECT * FROM tr")
def trim_to_snapshot(spark, sf_dir):
    return chunks.trim_to_snapshot(v.book_events(spark, sf_dir), on_missing="drop")


@query(f"""WITH {BOOKS_SQL} SELECT *, CAST((dense_rank() OVER (PARTITION BY "instId" ORDER BY "timestamp") - 1) // {CHUNK} AS BIGINT) AS chunk FROM be""")
def split_by_ts(spark, sf_dir):
    return chunks.split_by_ts(v.book_events(spark, sf_dir), CHUNK)


_PARTS = f"""{_TRIMMED}, rk AS (SELECT *, dense_rank() OVER (PARTITION BY "instId" ORDER BY "timestamp") AS r FROM tr),
mx AS (SELECT "instId", max(r) AS ranks FROM rk GROUP BY 1), lp AS (SELECT "instId", (ranks - 1) // {CHUNK} - CASE WHEN (ranks - 1) % {CHUNK} = 0 THEN 1 ELSE 0 END AS last_part FROM mx),
ft AS (SELECT DISTINCT "instId", (r - 1) // {CHUNK} AS part, "timestamp" AS t FROM rk WHERE (r - 1) % {CHUNK} = 0),
sn AS (SELECT DISTINCT "instId", "timestamp" AS t FROM rk WHERE action = 'snapshot'), cl AS (SELECT k.seq, min(s.t) AS clr FROM rk k JOIN sn s ON s."instId" = k."instId" AND s.t > k."timestamp" GROUP BY 1),
ld AS (SELECT k.*, lead(k."timestamp") OVER (PARTITION BY k."instId", side, price ORDER BY k."timestamp", k.seq) AS nxt, clr FROM rk k LEFT JOIN cl USING (seq)),
st AS (SELECT *, least(coalesce(nxt, clr), coalesce(clr, nxt)) AS e FROM ld),
pt AS (SELECT st."instId", CAST(ft.part AS BIGINT) AS part, ft.t AS "timestamp", side, price, size, "numOrders", 'snapshot' AS action, CAST(NULL AS BIGINT) AS seq
  FROM st JOIN ft ON ft."instId" = st."instId" AND st."timestamp" <= ft.t AND (e IS NULL OR ft.t < e) JOIN lp ON lp."instId" = st."instId" AND ft.part <= last_part WHERE size > 0
  UNION ALL SELECT rk."instId", CAST((r - 1) // {CHUNK} AS BIGINT), "timestamp", side, price, size, "numOrders", action, seq FROM rk JOIN lp USING ("instId") WHERE (r - 1) % {CHUNK} <> 0 AND (r - 1) // {CHUNK} <= last_part)"""


@query(f"WITH {_PARTS} SELECT * FROM pt")
def chunked_dataset(spark, sf_dir):
    return chunks.chunked_dataset(v.book_events(spark, sf_dir), CHUNK, on_missing="drop")


@query(f"""WITH {_PARTS} SELECT "instId", part, min("timestamp") AS min_timestamp, max("timestamp") AS max_timestamp, count(*) AS rows FROM pt GROUP BY ALL""")
def part_catalog(spark, sf_dir):
    """The catalog, from parts that were written and read back."""
    path = scratch(spark, "parts")
    datasets.write_parts(chunks.chunked_dataset(v.book_events(spark, sf_dir), CHUNK, on_missing="drop"), path)
    return spark.read.parquet(f"{path}/catalog")


@query(f"""WITH {BOOKS_SQL} SELECT "instId", count(*) AS rows, min("timestamp") AS min_timestamp, max("timestamp") AS max_timestamp FROM be GROUP BY 1""")
def compact_stats(spark, sf_dir):
    """What a dataset of many small files holds after its compaction."""
    path = scratch(spark, "small")
    v.book_events(spark, sf_dir).repartition(16).write.partitionBy("instId").parquet(path)
    datasets.compact(spark, path, f"{path}-compact")
    rows = spark.read.parquet(f"{path}-compact")
    return rows.groupBy("instId").agg(F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("min_timestamp"), F.max("timestamp").alias("max_timestamp"))


@query(f"""WITH {BOOKS_SQL} SELECT DISTINCT "instId" FROM be""")
def list_datasets(spark, sf_dir):
    return datasets.list_datasets(v.book_events(spark, sf_dir))


@query(f"""WITH {BOOKS_SQL} SELECT * FROM be WHERE "instId" = 'INST-1'""")
def by_instrument(spark, sf_dir):
    return datasets.by_instrument(v.book_events(spark, sf_dir), "INST-1")


@query(f"""WITH {BOOKS_SQL} SELECT *, row_number() OVER (PARTITION BY "instId" ORDER BY "timestamp", seq) AS place FROM be""")
def sorted_rows(spark, sf_dir):
    from ..operators.scan import ranked

    return ranked(ingest.sorted_rows(v.book_events(spark, sf_dir)), ["instId"], "timestamp", "place", distinct=False, ties=("seq",))


# --- ingest


@query("""SELECT 'INST-' || (user_id % 4) AS "instId", epoch_ns(ts) // 1000000 AS "timestamp", event_id AS "tradeId", floor(value) AS px, CAST(event_id % 50 AS DOUBLE) AS sz, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side FROM events""")
def flatten_trades(spark, sf_dir):
    return ingest.flatten_trades(v.messages(spark, sf_dir, "trades"))


def _apart(*names: str) -> str:
    return ", ".join(f'floor(value) + {k} AS "{x}"' for k, x in enumerate(names))


@query(f"""SELECT 'INST-' || (user_id % 4) AS "instId", 'SWAP' AS "instType", epoch_ns(ts) // 1000000 AS "timestamp", {_apart("last", "lastSz", "askPx", "askSz", "bidPx", "bidSz", "open24h", "high24h", "low24h", "volCcy24h", "vol24h", "sodUtc0", "sodUtc8")} FROM events""")
def flatten_tickers(spark, sf_dir):
    return ingest.flatten_tickers(v.messages(spark, sf_dir, "tickers"))


@query("""SELECT 'INST-' || (user_id % 4) AS "instId", 'SWAP' AS "instType", epoch_ns(ts) // 1000000 AS "timestamp", event_id * 3 AS oi, floor(value) AS "oiCcy" FROM events""")
def flatten_open_interest(spark, sf_dir):
    return ingest.flatten_open_interest(v.messages(spark, sf_dir, "open_interest"))


@query("""SELECT 'INST-' || (user_id % 4) AS "instId", 'SWAP' AS "instType", epoch_ns(ts) // 1000000 AS "timestamp", floor(value) AS "markPx" FROM events""")
def flatten_mark_price(spark, sf_dir):
    return ingest.flatten_mark_price(v.messages(spark, sf_dir, "mark_price"))


@query("""WITH d AS (SELECT 'INST-' || (user_id % 4) AS "instId", epoch_ns(ts) // 1000000 AS "timestamp", event_type AS uly, event_id, CAST(floor(value) AS BIGINT) AS p FROM events)
SELECT 'SWAP' AS "instType", "instId", "timestamp", uly, 'buy' AS side, '' AS "posSide", CAST(p AS VARCHAR) AS "bkPx", '' AS sz, '' AS "bkLoss", '' AS ccy FROM d
UNION ALL SELECT 'SWAP', "instId", "timestamp", uly, '', '', '', CAST(event_id AS VARCHAR), '', '' FROM d""")
def flatten_liquidations(spark, sf_dir):
    return ingest.flatten_liquidations(v.messages(spark, sf_dir, "liquidations"))


@query(f"""SELECT 'INST-' || (user_id % 4) AS "instId", epoch_ns(ts) // 1000000 AS "timestamp", {_apart("idxPx", "high24h", "low24h", "open24h", "sodUtc0", "sodUtc8")} FROM events""")
def flatten_index_tickers(spark, sf_dir):
    return ingest.flatten_index_tickers(v.messages(spark, sf_dir, "index_tickers"))


@query(f"""WITH {BOOKS_SQL}, k AS (SELECT "instId", "timestamp", min(seq) AS s FROM be GROUP BY 1, 2)
SELECT "instId", CAST(price AS VARCHAR) AS price, CAST(size AS VARCHAR) AS size, "numOrders", side, "timestamp", CAST(NULL AS BIGINT) AS "prevSeqId", s AS "seqId", action FROM be JOIN k USING ("instId", "timestamp")""")
def flatten_books(spark, sf_dir):
    return ingest.flatten_books(v.messages(spark, sf_dir, "books")).drop("seq", "checksum")


@query(f"""WITH {BOOKS_SQL}, k AS (SELECT "instId", "timestamp", min(seq) AS s FROM be GROUP BY 1, 2)
SELECT "instId", price, size, "numOrders", side, "timestamp", s AS "seqId", action FROM be JOIN k USING ("instId", "timestamp")""")
def conform_schema(spark, sf_dir):
    """Text prices to numbers under a declared schema."""
    flat = ingest.flatten_books(v.messages(spark, sf_dir, "books"))
    schema = BOOKS_RAW.replace("price string, size string", "price double, size double")
    return ingest.conform(flat, schema).drop("checksum", "prevSeqId")


@query("""SELECT 'trades' AS file, event_id AS n, CAST(event_id % 3 AS INTEGER) AS payloads FROM events WHERE event_id % 3 <> 1""")
def guard_single_payload(spark, sf_dir):
    """Messages that hold no payload or two."""
    m = v.messages(spark, sf_dir, "trades")
    one = F.get("message.data", 0)
    many = F.when(F.col("n") % 3 == 1, F.array(one)).when(F.col("n") % 3 == 2, F.array(one, one)).otherwise(F.slice("message.data", 1, 0))
    return ingest.guard_single_payload(m.withColumn("message", F.struct(many.alias("data"))))


@query("""SELECT 'INST-' || (user_id % 4) AS "instId", epoch_ns(ts) // 1000000 AS "timestamp", event_id AS "tradeId" FROM events""")
def read_messages(spark, sf_dir):
    """Messages written as files of JSON objects and read back."""
    path = scratch(spark, "dumps")
    v.write_dumps(spark, sf_dir, path)
    return ingest.flatten_trades(ingest.read_messages(spark, path, "trades", glob="OKX-Trades-*")).select("instId", "timestamp", "tradeId")


_DUMPS = f"""dm AS (SELECT 'INST-' || (user_id % 4) AS "instId", epoch_ns(ts) // 1000000 AS "timestamp", event_id AS "tradeId", event_id // {v.DUMP} * {v.DUMP} AS f FROM events)"""


@query(f"""WITH {_DUMPS}, df AS (SELECT DISTINCT "instId" || '-400' AS "dsID", f FROM dm) SELECT "dsID", CAST(f AS VARCHAR) AS "startTimestamp", CAST(f + {v.DUMP - 1} AS VARCHAR) AS "endTimestamp", row_number() OVER (PARTITION BY "dsID" ORDER BY f) AS ordinal FROM df""")
def file_manifest(spark, sf_dir):
    """The dump files found in a folder, with their order in their dataset."""
    path = scratch(spark, "dumps")
    v.write_dumps(spark, sf_dir, path)
    files = ingest.find_files(spark, path, "Trades")
    told = ingest.file_manifest(files, datasets.TARGET_BYTES, width=100 * v.DUMP)
    return told.join(files.select("filePath", "startTimestamp", "endTimestamp"), "filePath").select("dsID", "startTimestamp", "endTimestamp", "ordinal")


@query(f"""WITH {_DUMPS} SELECT "instId" || '-400' AS "dsID", "instId", "timestamp", "tradeId", row_number() OVER (PARTITION BY "instId" ORDER BY "timestamp", "tradeId") AS place FROM dm""")
def ordered_dumps(spark, sf_dir):
    """Dumps found, read, written flat in order, and read back with the place that each row has in its dataset's files."""
    path = scratch(spark, "dumps")
    v.write_dumps(spark, sf_dir, path)
    names_of = ingest.find_files(spark, path, "Trades").select(F.regexp_extract("filePath", "[^/]*$", 0).alias("file"), "dsID")
    messages = ingest.read_messages(spark, path, "trades", glob="OKX-Trades-*").join(names_of, "file")
    flat = ingest.flatten_trades(messages).withColumn("dsID", F.concat("instId", F.lit("-400")))
    datasets.write_flat(flat, f"{path}-flat", "dsID", "timestamp", "tradeId")
    rows = datasets.with_places(datasets.read_ordered(spark, f"{path}-flat"))
    return rows.select("dsID", "instId", "timestamp", "tradeId", "place")


@query(f"""WITH {NAMES_SQL} SELECT 'OKX' AS exchange, source AS "dataSource", ds AS "dsID", CAST(n AS VARCHAR) AS "startTimestamp", CAST(n + 60 AS VARCHAR) AS "endTimestamp", regexp_replace(ds, '-400$', '') AS "instId" FROM nm""")
def parse_file_name(spark, sf_dir):
    parsed = v.file_names(spark, sf_dir).select(names.parse_file_name(F.col("name")).alias("m")).select("m.*")
    return parsed.withColumn("instId", inst_of(F.col("dsID")))


@query(f"""WITH {NAMES_SQL} SELECT 'OKX' AS exchange, source AS "dataSource", ds AS "dsID", CAST(n AS VARCHAR) AS "startTimestamp", CAST(n + 60 AS VARCHAR) AS "endTimestamp" FROM nm WHERE source = 'Books'""")
def file_meta(spark, sf_dir):
    return v.file_names(spark, sf_dir).select(names.parse_file_name(F.col("name")).alias("m")).select("m.*").where("dataSource = 'Books'")


@query(f"""WITH {NAMES_SQL} SELECT ds AS "dsID", string_agg(n || '', ',' ORDER BY n) AS starts FROM nm GROUP BY 1""")
def files_per_dataset(spark, sf_dir):
    files = v.file_names(spark, sf_dir).select(F.col("name").alias("filePath"), names.parse_file_name(F.col("name")).alias("m")).select("filePath", "m.*")
    starts = F.array_join(F.transform("files", lambda f: F.element_at(F.split(f, "-"), -2)), ",")
    return ingest.files_per_dataset(files).select("dsID", starts.alias("starts"))


# --- contracts


@query(f"""WITH {NAMES_SQL} SELECT ds AS "dsID", regexp_matches(regexp_replace(ds, '-400$', ''), '^[^-]+-[^-]+-[0-9]+-[^-]+$') AS dated, regexp_matches(ds || '-X', '^[^-]+-[^-]+-[0-9]+-[^-]+$') AS dated_x FROM (SELECT DISTINCT ds FROM nm)""")
def is_dated_future(spark, sf_dir):
    ids = v.file_names(spark, sf_dir).select(names.parse_file_name(F.col("name")).dsID.alias("dsID")).distinct()
    return ids.select("dsID", contract.is_dated_future(inst_of(F.col("dsID"))).alias("dated"), contract.is_dated_future(F.concat("dsID", F.lit("-X"))).alias("dated_x"))


@query(f"""WITH {CONTRACTS_SQL} SELECT event_id, CASE WHEN "left" <= 0 THEN NULL WHEN "left" <= 604800000 THEN 'this_week' WHEN "left" <= 1209600000 THEN 'next_week' WHEN cyc AND "left" <= 7862400000 THEN 'this_quarter' WHEN cyc AND "left" <= 15724800000 THEN 'next_quarter' ELSE 'other' END AS alias,
"left" > 0 AND "left" <= 604800000 AS is_this_week, "left" > 604800000 AND "left" <= 1209600000 AS is_next_week, cyc AND "left" > 0 AND "left" <= 7862400000 AS is_this_quarter, cyc AND "left" > 7862400000 AND "left" <= 15724800000 AS is_next_quarter FROM ca""")
def contract_alias(spark, sf_dir):
    now, day = F.col("now_ms"), F.col("day")
    return v.contracts(spark, sf_dir).select("event_id", contract.contract_alias(now, day).alias("alias"), *(c.alias(k) for k, c in contract.alias_flags(now, day).items()))


@query(f"""WITH {CONTRACTS_SQL} SELECT event_id, 'C' || (event_id % 7) || '-USD-TWEEK' AS "instId" FROM ca WHERE "left" > 0 AND "left" <= 604800000""")
def continuous_contract(spark, sf_dir):
    c = v.contracts(spark, sf_dir)
    ds = F.concat(F.lit("C"), (F.col("event_id") % 7).cast("string"), F.lit("-USD-"), F.col("day"), F.lit("-F-400"))
    rows = c.select("event_id", ds.alias("dsID"), F.col("now_ms").alias("startTimestamp"))
    return contract.continuous_contract(rows, rows.select("dsID", "startTimestamp")).select("event_id", "instId")


# --- delta, checksums and sessions


_FULL = f"""fb AS (SELECT "instId", ts AS "timestamp", side, price, size, "numOrders" FROM grid), tm AS (SELECT "instId", "timestamp", lead("timestamp") OVER (PARTITION BY "instId" ORDER BY "timestamp") AS nx FROM (SELECT DISTINCT "instId", "timestamp" FROM fb)),
rm AS (SELECT f."instId", t.nx AS "timestamp", f.side, f.price, f."numOrders" FROM fb f JOIN tm t USING ("instId", "timestamp") WHERE t.nx IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fb g WHERE g."instId" = f."instId" AND g."timestamp" = t.nx AND g.side = f.side AND g.price = f.price)),
un AS (SELECT "instId", "timestamp", side, price, CAST(0 AS DOUBLE) AS size, "numOrders", 'update' AS action, 0 AS o FROM rm
  UNION ALL SELECT "instId", "timestamp", side, price, size, "numOrders", CASE WHEN "timestamp" = min("timestamp") OVER (PARTITION BY "instId") THEN 'snapshot' ELSE 'update' END, 1 FROM fb)"""


@query(f"""WITH {GRID_SQL}, {_FULL} SELECT "instId", "timestamp", side, price, size, "numOrders", action, row_number() OVER (PARTITION BY "instId", "timestamp" ORDER BY o, side, price) AS seq FROM un""")
def delta_encode(spark, sf_dir):
    full = book.book_grid(v.book_events(spark, sf_dir), *SPAN).withColumnRenamed("ts", "timestamp").drop("lvl")
    return delta.delta_encode(full)


@query(f"""WITH {BOOKS_SQL}, g AS (SELECT "instId", "timestamp", arg_min(action, seq) AS action FROM be WHERE "timestamp" % 3600000 <> 1800000 GROUP BY 1, 2),
o AS (SELECT *, CASE WHEN "timestamp" - coalesce(lag("timestamp") OVER (PARTITION BY "instId" ORDER BY "timestamp"), 0) > 600000 THEN 1 ELSE 0 END AS op FROM g),
s AS (SELECT *, CAST(sum(op) OVER (PARTITION BY "instId" ORDER BY "timestamp") AS BIGINT) AS session FROM o),
f AS (SELECT "instId", session, min("timestamp") FILTER (WHERE action = 'snapshot') AS t FROM s GROUP BY 1, 2)
SELECT "instId", "timestamp", action, session FROM s JOIN f USING ("instId", session) WHERE session = 0 OR "timestamp" >= t""")
def gap_sessions(spark, sf_dir):
    """Sessions of a feed that is silent around every half hour."""
    books = v.book_events(spark, sf_dir).where("timestamp % 3600000 <> 1800000")
    return checksum.gap_sessions(checksum.timestamp_groups(books), silence=600_000)


_TEXTS = f"""{INTERVALS_SQL}, tt AS (SELECT DISTINCT "instId", "timestamp" FROM be),
sb AS (SELECT t."instId", t."timestamp", side, price || ':' || size AS part, row_number() OVER (PARTITION BY t."instId", t."timestamp", side ORDER BY CASE WHEN side = 'ask' THEN price ELSE -price END) AS lvl
  FROM tt t JOIN live l ON l."instId" = t."instId" AND valid_from <= t."timestamp" AND (valid_to IS NULL OR t."timestamp" < valid_to)),
tx AS (SELECT "instId", "timestamp", string_agg(part, ':' ORDER BY lvl, side = 'ask') AS text FROM sb WHERE lvl <= 25 GROUP BY 1, 2)"""


@query(f"""WITH {_TEXTS} SELECT "instId", "timestamp", coalesce(text, '') AS text FROM tt LEFT JOIN tx USING ("instId", "timestamp")""")
def checksum_text(spark, sf_dir):
    return checksum.checksum_text(v.raw_books(spark, sf_dir))


def _with_stated_checksums(spark, sf_dir):
    """A feed whose stated checksums are those of its own text, but for one group in seven."""
    raw = v.raw_books(spark, sf_dir)
    stated = checksum.checksum_text(raw).select("instId", "timestamp", (checksum.signed_crc32(F.col("text")) + (F.col("timestamp") / v.TEN_MINUTES % 7 == 0).cast("int")).alias("checksum"))
    return raw.join(stated, ["instId", "timestamp"])


#: CRC-32 in SQL for texts (t) of nt: cz(d, b, v) is what byte b adds with d bytes after it, ci(n, v) the register after n zero bytes; a checksum (cr) is the xor of the shares of all bytes and the length.
_CRC = """cb AS (SELECT CAST(b AS BIGINT) AS b, CAST(b AS BIGINT) AS v, 0 AS k FROM range(256) r(b) UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM cb WHERE k < 8),
ct AS (SELECT b, v FROM cb WHERE k = 8), most AS (SELECT coalesce(max(length(t)), 0) AS most FROM nt),
cz AS (SELECT 0 AS d, b, v FROM ct UNION ALL SELECT d + 1, cz.b, xor(ct.v, cz.v >> 8) FROM cz JOIN ct ON ct.b = cz.v & 255 WHERE d < (SELECT most FROM most)),
ci AS (SELECT 0 AS n, CAST(4294967295 AS BIGINT) AS v UNION ALL SELECT n + 1, xor(ct.v, ci.v >> 8) FROM ci JOIN ct ON ct.b = ci.v & 255 WHERE n < (SELECT most FROM most)),
bt AS (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM nt),
cv AS (SELECT t, bit_xor(cz.v) AS x FROM bt JOIN cz ON cz.d = length(t) - i AND cz.b = ascii(substring(t, CAST(i AS INTEGER), 1)) GROUP BY t),
cr AS (SELECT nt.t, xor(xor(coalesce(x, 0), ci.v), 4294967295) AS c FROM nt JOIN ci ON ci.n = length(nt.t) LEFT JOIN cv ON cv.t = nt.t)"""
_CHECKED = f"""RECURSIVE {_TEXTS}, al AS (SELECT "instId", "timestamp", coalesce(text, '') AS text FROM tt LEFT JOIN tx USING ("instId", "timestamp")), nt AS (SELECT DISTINCT text AS t FROM al), {_CRC},
ck AS (SELECT al.*, CASE WHEN c >= 2147483648 THEN c - 4294967296 ELSE c END AS checksum FROM al JOIN cr ON cr.t = al.text)"""


@query(f"""WITH {_CHECKED}, fs AS (SELECT "instId", min("timestamp") AS f FROM be WHERE action = 'snapshot' GROUP BY 1)
SELECT ck."instId", ck."timestamp", text, checksum FROM ck JOIN fs ON fs."instId" = ck."instId" WHERE ck."timestamp" >= f""")
def replayed_checksums(spark, sf_dir):
    """Text and signed CRC-32 of the best levels, by a replay of parts of 500 rows."""
    return checksum.replayed_checksums(v.raw_books(spark, sf_dir), rows=500)


@query(f"""WITH {_CHECKED}, sd AS (SELECT "instId", "timestamp", checksum + CASE WHEN "timestamp" // 600000 % 7 = 0 THEN 1 ELSE 0 END AS stated FROM ck),
g AS (SELECT "instId", "timestamp", arg_min(action, seq) AS action FROM be GROUP BY 1, 2),
o AS (SELECT *, CASE WHEN "timestamp" - coalesce(lag("timestamp") OVER (PARTITION BY "instId" ORDER BY "timestamp"), 0) > 60000 THEN 1 ELSE 0 END AS op FROM g),
s AS (SELECT *, sum(op) OVER (PARTITION BY "instId" ORDER BY "timestamp") AS session FROM o),
f AS (SELECT "instId", session, min("timestamp") FILTER (WHERE action = 'snapshot') AS t FROM s GROUP BY 1, 2),
cn AS (SELECT s."instId", s."timestamp" FROM s JOIN f ON f."instId" = s."instId" AND f.session = s.session WHERE s.session = 0 OR s."timestamp" >= t),
ok AS (SELECT cn."instId", ck.checksum = sd.stated AS ok FROM cn JOIN ck ON ck."instId" = cn."instId" AND ck."timestamp" = cn."timestamp" JOIN sd ON sd."instId" = cn."instId" AND sd."timestamp" = cn."timestamp")
SELECT i."instId", count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed, CASE WHEN count(ok) > 0 THEN count(*) FILTER (WHERE ok) / count(ok) END AS ratio FROM (SELECT DISTINCT "instId" FROM be) i LEFT JOIN ok ON ok."instId" = i."instId" GROUP BY 1""")
def checksum_report(spark, sf_dir):
    """The feed states its own checksums, one in seven of them wrong; the report replays it."""
    path = scratch(spark, "stated")
    _with_stated_checksums(spark, sf_dir).write.parquet(path)
    return checksum.checksum_report(spark.read.parquet(path), rows=500)


# --- series


@query(f"WITH {SERIES_SQL}, l AS (SELECT *, lag(val) OVER (PARTITION BY series_id ORDER BY ts) AS p FROM ev) SELECT series_id, ts, round(ln(val / p), 9) AS val FROM l WHERE p IS NOT NULL")
def log_delta(spark, sf_dir):
    return series.log_delta(v.event_series(spark, sf_dir), width=WIDTH).withColumn("val", F.round("val", 9))


@query(f"""WITH RECURSIVE {SERIES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM ev),
a AS (SELECT series_id, array_agg(val ORDER BY i) AS xs, array_agg(ts ORDER BY i) AS t FROM n GROUP BY 1),
s AS (SELECT series_id, xs, t, 1 AS i, xs[1] AS s FROM a UNION ALL SELECT series_id, xs, t, i + 1, 0.25 * xs[i + 1] + 0.75 * s FROM s WHERE i < len(xs))
SELECT series_id, t[i] AS ts, round(CAST(s AS DOUBLE), 6) AS val FROM s""")
def exp_smoothing(spark, sf_dir):
    return series.exp_smoothing(v.event_series(spark, sf_dir), 0.25, block=WIDTH // 8, width=WIDTH).withColumn("val", F.round("val", 6))


def _rolling(fold: str) -> str:
    return f"WITH {SERIES_SQL}, w AS (SELECT series_id, ts, {fold}(val) OVER f AS val, count(*) OVER f AS n FROM ev WINDOW f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) SELECT series_id, ts, round(val, 6) AS val FROM w WHERE n = 8"


@query(_rolling("avg"))
def rolling_mean(spark, sf_dir):
    return series.rolling(v.event_series(spark, sf_dir), 8, "mean", block=WIDTH // 8, width=WIDTH).withColumn("val", F.round("val", 6))


@query(_rolling("var_pop"))
def rolling_var(spark, sf_dir):
    return series.rolling(v.event_series(spark, sf_dir), 8, "var", block=WIDTH // 8, width=WIDTH).withColumn("val", F.round("val", 6))


def _last(fold: str) -> str:
    return f"WITH {SERIES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS i FROM ev) SELECT series_id, round({fold}(val), 6) AS val FROM n WHERE i <= 20 GROUP BY 1"


@query(_last("avg"))
def last_n_mean(spark, sf_dir):
    return series.last_n(v.event_series(spark, sf_dir), 20, "mean").withColumn("val", F.round("val", 6))


@query(_last("var_pop"))
def last_n_var(spark, sf_dir):
    return series.last_n(v.event_series(spark, sf_dir), 20, "var").withColumn("val", F.round("val", 6))


@query(f"""WITH {SERIES_SQL}, a AS (SELECT series_id, ts, CASE WHEN ts % 5 = 0 THEN NULL ELSE val END AS val FROM ev WHERE ts % 3 <> 0), b AS (SELECT series_id, ts, CASE WHEN ts % 7 = 0 THEN NULL ELSE val * 2 END AS val FROM ev WHERE ts % 2 <> 0)
SELECT coalesce(a.series_id, b.series_id) AS series_id, coalesce(a.ts, b.ts) AS ts, CASE WHEN a.val IS NULL AND b.val IS NULL THEN NULL ELSE coalesce(a.val, 0) - coalesce(b.val, 0) END AS val FROM a FULL JOIN b ON a.series_id = b.series_id AND a.ts = b.ts""")
def series_gap(spark, sf_dir):
    s, nan = v.event_series(spark, sf_dir), F.lit(float("nan"))
    a = s.where("ts % 3 <> 0").withColumn("val", F.when(F.col("ts") % 5 == 0, nan).otherwise(F.col("val")))
    b = s.where("ts % 2 <> 0").withColumn("val", F.when(F.col("ts") % 7 != 0, F.col("val") * 2))
    return series.series_gap(a, b)


_MINUTES = f"{PRICE_SQL}, mm AS (SELECT series_id, ts // 60000 AS minute, avg(val) AS val FROM ps GROUP BY ALL)"


@query(f"WITH {_MINUTES} SELECT series_id, minute, round(val, 9) AS val FROM mm")
def minute_mean(spark, sf_dir):
    return series.minute_mean(v.price_series(spark, sf_dir)).withColumn("val", F.round("val", 9))


@query(f"""WITH {_MINUTES}, fr AS (SELECT a.series_id, a.minute AS s, min(b.val) AS lo, max(b.val) AS hi, count(*) AS n FROM mm a JOIN mm b ON a.series_id = b.series_id AND b.minute BETWEEN a.minute AND a.minute + 5 GROUP BY ALL)
SELECT series_id, s AS start_minute, s + 5 AS end_minute, round((hi - lo) / lo, 9) AS val FROM fr WHERE n = 6 AND (hi - lo) / lo > 0.05""")
def price_change_intervals(spark, sf_dir):
    return series.price_change_intervals(v.price_series(spark, sf_dir), 5, 0.05, on_gap="skip").withColumn("val", F.round("val", 9))


@query(f"WITH {SERIES_SQL} SELECT * FROM ev WHERE ts = 77")
def series_at(spark, sf_dir):
    return series.series_at(v.event_series(spark, sf_dir), 77)


@query(f"WITH {SERIES_SQL} SELECT * FROM ev WHERE ts BETWEEN 50 AND 150")
def series_between(spark, sf_dir):
    return series.series_between(v.event_series(spark, sf_dir), 50, 150)


# --- points


def _points(spark, sf_dir):
    return points.to_points(tv(spark, sf_dir), "TV", "OKX", "SWAP", str(N))


_POINTS = f"""tvs AS ({ORACLE_SQL["tv"]}), pp AS (SELECT 'TV' AS measurement, 'OKX' AS exchange, "instId", 'SWAP' AS "instType", '{N}' AS level, side, ts AS ts_ms, val FROM tvs WHERE val IS NOT NULL)"""


@query(f"WITH {_POINTS} SELECT * FROM pp")
def indicator_points(spark, sf_dir):
    """Points written by measurement and read back; times in milliseconds here."""
    path = scratch(spark, "points")
    points.write_points(_points(spark, sf_dir), path)
    return spark.read.parquet(path).withColumn("ts_ms", F.unix_millis("ts")).drop("ts")


@query(f"""WITH {_POINTS} SELECT "instId", side, ts_ms, val FROM pp WHERE ts_ms BETWEEN {END} - 86400000 AND {END}""")
def points_range(spark, sf_dir):
    now = F.timestamp_millis(F.lit(END))
    return points.points_since(_points(spark, sf_dir), now, 86_400).select("instId", "side", F.unix_millis("ts").alias("ts_ms"), "val")


@query(f"WITH {_POINTS} SELECT count(*) * 8 AS cells FROM pp")
def points_cells(spark, sf_dir):
    return points.cell_count(_points(spark, sf_dir))


@query(f"WITH {_POINTS} SELECT * FROM pp")
def points_text(spark, sf_dir):
    """Points written as lines and as a table of text, each read back: those that both hold."""
    path, own = scratch(spark, "points"), _points(spark, sf_dir)
    points.write_lines(own, f"{path}-lines")
    points.write_csv(own, f"{path}-csv")
    lines, table = points.read_lines(spark, f"{path}-lines"), points.read_csv(spark, f"{path}-csv")
    return lines.intersectAll(table.select(*lines.columns)).withColumn("ts_ms", F.unix_millis("ts")).drop("ts")


# --- streams


_BOOK_SQL = INTERVALS_SQL.replace(BOOKS_SQL, v.ARRIVING_SQL)


@query(f"""WITH {_BOOK_SQL}, nw AS (SELECT "instId", max("timestamp") AS t FROM be GROUP BY 1)
SELECT 'book' AS kind, l."instId", t AS "timestamp", CAST(NULL AS BIGINT) AS seq, side, CAST(row_number() OVER (PARTITION BY l."instId", side ORDER BY CASE WHEN side = 'ask' THEN price ELSE -price END) AS INTEGER) AS lvl, price, size, "numOrders", CAST(NULL AS VARCHAR) AS action
FROM live l JOIN nw ON nw."instId" = l."instId" WHERE valid_to IS NULL
UNION ALL SELECT 'late', "instId", "timestamp", seq, side, NULL, price, size, "numOrders", action FROM lt""")
def stream_book(spark, sf_dir):
    """The whole book after the last micro-batch of a feed that arrives in files, some rows late, and the late rows."""
    out = scratch(spark, "stream-book")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.STORE)
    try:
        stream = streams.stream_book(v.arriving_feed(spark, sf_dir, f"{out}/feed"), lateness=v.SLICE)
        run = streams.write_book(stream, f"{out}/rows", f"{out}/checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    run.awaitTermination()
    rows = streams.written(spark, f"{out}/rows")
    book = streams.last_books(rows).withColumns({"kind": F.lit("book"), "seq": F.lit(None).cast("long"), "action": F.lit(None).cast("string")})
    return book.unionByName(rows.where("kind = 'late'").drop("batch"))


@query(f"""WITH {_PARTS.replace(BOOKS_SQL, v.ARRIVING_SQL)} SELECT * FROM pt UNION ALL SELECT "instId", NULL, "timestamp", side, price, size, "numOrders", action, seq FROM lt""")
def stream_chunks(spark, sf_dir):
    """Chunks of a feed that arrives in files, closed when no row of theirs can come, flushed at its end; late rows have no part."""
    out = scratch(spark, "stream-chunks")
    run = streams.stream_chunks(v.arriving_feed(spark, sf_dir, f"{out}/feed"), out, CHUNK, f"{out}/checkpoint", lateness=v.SLICE).trigger(availableNow=True).start()
    run.awaitTermination()
    streams.close_chunks(spark, out, run.lastProgress["batchId"], CHUNK)
    found = streams.closed_chunks(spark, out)
    kept = found.select(*chunks.COLUMNS, F.when(F.col("seq") >= 0, F.col("seq")).alias("seq"))
    return kept.unionByName(streams.late_chunk_rows(spark, out).withColumn("part", F.lit(None).cast("long")))
