"""Raw websocket dumps: reading files of messages and flattening them into tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.names import parse_file_name
from ..operators.book import DAY
from ..operators.scan import ranked, running
from ..schemas import MESSAGES


def find_files(spark: SparkSession, path: str, source: str | None = None, recursive: bool = False) -> DataFrame:
    """(filePath, bytes, exchange, dataSource, dsID, startTimestamp, endTimestamp) of data files under path; none is an error. No file is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("pathGlobFilter", f"*-{source}-*" if source else "*-*")
    files = reader.load(path).select(F.col("path").alias("filePath"), F.col("length").alias("bytes"), parse_file_name(F.col("path")).alias("m")).select("filePath", "bytes", "m.*")
    if source:
        files = files.where(F.col("dataSource") == source)
    if files.isEmpty():
        raise FileNotFoundError(f"no data file under {path}")
    return files


def files_per_dataset(files: DataFrame) -> DataFrame:
    """(dsID, files): each dataset's file paths in the order of their start; numbers, since texts of different length sort otherwise. For lists that a row can hold; file_manifest has no such bound."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col("startTimestamp").cast("long").alias("at"), "filePath")))
    return files.groupBy("dsID").agg(F.transform(ordered, lambda x: x.filePath).alias("files"))


def file_manifest(files: DataFrame, target: int, width: int = DAY) -> DataFrame:
    """(dsID, filePath, bytes, ordinal, bin) of find_files: each file's number in its dataset, from 1 by start, and the bin of about target bytes that it falls into, from 0.

    A dataset of any number of files is rows, not one list, and a bin is a task's share of it.
    """
    timed = files.select("dsID", "filePath", "bytes", F.col("startTimestamp").cast("long").alias("start"))
    numbered = ranked(timed, ["dsID"], "start", "ordinal", width, distinct=False, ties=("filePath",))
    before = running(numbered, ["dsID"], "ordinal", "bytes", "before", inclusive=False)
    return before.select("dsID", "filePath", "bytes", "ordinal", F.floor(F.coalesce("before", F.lit(0)) / target).cast("long").alias("bin"))


def read_messages(spark: SparkSession, path: str, channel: str, glob: str = "*.json", recursive: bool = False) -> DataFrame:
    """(file, n, message): the messages of all files, each an object whose data array holds them, with their place in the file."""
    files = spark.read.schema(f"data array<{MESSAGES[channel]}>").option("multiLine", True).option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).json(path)
    return files.select(F.col("_metadata.file_name").alias("file"), F.posexplode("data").alias("n", "message"))


def _single(data: str, mode: str) -> Column:
    """The one element of a payload list; another length is an error, or null with mode quarantine."""
    one = F.size(F.col(data)) == 1
    if mode == "quarantine":
        return F.when(one, F.get(F.col(data), 0))
    return F.when(one, F.get(F.col(data), 0)).otherwise(F.raise_error(F.concat(F.lit("a message holds payloads: "), F.coalesce(F.size(F.col(data)), F.lit(0)).cast("string"))).cast("void"))


def guard_single_payload(messages: DataFrame) -> DataFrame:
    """(file, n, payloads) of messages whose payload list has not one element."""
    size = F.coalesce(F.size("message.data"), F.lit(0))
    return messages.select("file", "n", size.alias("payloads")).where(F.col("payloads") != 1)


def _payload(messages: DataFrame, mode: str) -> DataFrame:
    found = messages.select("file", "n", "message", _single("message.data", mode).alias("p"))
    return found.where("p is not null") if mode == "quarantine" else found


def flatten_books(messages: DataFrame, mode: str = "raise") -> DataFrame:
    """One row per level, asks first, in the message's order; seq orders the rows of a file."""
    rows = _payload(messages, mode).select("file", "n", "message.arg.instId", "message.action", "p.*")
    sides = F.array(F.struct(F.lit("ask").alias("side"), F.lit(0).alias("s"), F.col("asks").alias("levels")), F.struct(F.lit("bid").alias("side"), F.lit(1).alias("s"), F.col("bids").alias("levels")))
    levels = rows.withColumn("x", F.explode(sides)).select("*", F.posexplode("x.levels").alias("i", "level"))
    order = F.struct("file", "n", F.col("x.s").alias("s"), "i")
    return levels.select(
        "instId", F.get("level", 0).alias("price"), F.get("level", 1).alias("size"), F.get("level", 3).cast("bigint").alias("numOrders"), F.col("x.side").alias("side"),
        F.col("ts").cast("bigint").alias("timestamp"), "prevSeqId", "seqId", "action", "checksum", order.alias("seq"),
    )


def _flat(columns: dict[str, str], inst: str = "p.instId") -> Callable[..., DataFrame]:
    def flatten(messages: DataFrame, mode: str = "raise") -> DataFrame:
        rows = _payload(messages, mode)
        typed = [F.col(f"p.{'ts' if name == 'timestamp' else name}").cast(kind).alias(name) for name, kind in columns.items()]
        return rows.select(F.col(inst).alias("instId"), *typed)

    return flatten


def _doubles(*names: str) -> dict[str, str]:
    return dict.fromkeys(names, "double")


flatten_trades = _flat({"timestamp": "bigint", "tradeId": "bigint", **_doubles("px", "sz"), "side": "string"})
flatten_tickers = _flat({"instType": "string", "timestamp": "bigint", **_doubles("last", "lastSz", "askPx", "askSz", "bidPx", "bidSz", "open24h", "high24h", "low24h", "volCcy24h", "vol24h", "sodUtc0", "sodUtc8")})
flatten_open_interest = _flat({"instType": "string", "timestamp": "bigint", "oi": "bigint", "oiCcy": "double"})
flatten_mark_price = _flat({"instType": "string", "timestamp": "bigint", "markPx": "double"})
flatten_index_tickers = _flat({"timestamp": "bigint", **_doubles("idxPx", "high24h", "low24h", "open24h", "sodUtc0", "sodUtc8")}, inst="message.arg.instId")


def flatten_liquidations(messages: DataFrame, mode: str = "raise") -> DataFrame:
    """One row per detail; missing texts are empty, a missing time is an error."""
    rows = _payload(messages, mode).select("p.instType", "p.instId", "p.uly", F.explode("p.details").alias("d"))
    text = lambda c: F.coalesce(F.col(f"d.{c}"), F.lit("")).alias(c)
    at = F.coalesce(F.col("d.ts").cast("bigint"), F.raise_error(F.lit("a liquidation has no ts")).cast("bigint"))
    return rows.select("instType", "instId", at.alias("timestamp"), F.coalesce("uly", F.lit("")).alias("uly"), *(text(c) for c in ("side", "posSide", "bkPx", "sz", "bkLoss", "ccy")))


FLATTEN = {"books": flatten_books, "trades": flatten_trades, "tickers": flatten_tickers, "open_interest": flatten_open_interest, "mark_price": flatten_mark_price, "liquidations": flatten_liquidations, "index_tickers": flatten_index_tickers}


def conform(rows: DataFrame, schema: str) -> DataFrame:
    """rows cast to a declared schema (DDL) and its order; what doesn't fit is an error."""
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)))


def sorted_rows(rows: DataFrame, tie: str = "seq") -> DataFrame:
    """rows by instrument and time, ties by a column, sorted inside partitions dealt by all three."""
    return rows.repartitionByRange("instId", "timestamp", tie).sortWithinPartitions("instId", "timestamp", tie)
