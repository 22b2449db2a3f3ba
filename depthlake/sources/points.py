"""Indicator points: measurement, tags and one field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import INDICATOR

TAGS = ["exchange", "instId", "instType", "level", "side"]


def to_points(series: DataFrame, measurement: str, exchange: str, inst_type: str, level: str) -> DataFrame:
    """The long form of an indicator's series (instId, side, ts in milliseconds, val)."""
    return series.where("val is not null").select(
        F.lit(measurement).alias("measurement"), F.lit(exchange).alias("exchange"), "instId", F.lit(inst_type).alias("instType"),
        F.lit(level).alias("level"), "side", F.timestamp_millis("ts").alias("ts"), "val",
    )


def write_points(points: DataFrame, path: str) -> None:
    points.write.mode("append").partitionBy("measurement").parquet(path)


def read_points(spark: SparkSession, path: str, measurement: str, now: Column, seconds: int) -> DataFrame:
    """The measurement's points of the last so many seconds before now."""
    return points_since(spark.read.parquet(path).where(F.col("measurement") == measurement), now, seconds)


def points_since(points: DataFrame, now: Column, seconds: int) -> DataFrame:
    return points.where((F.col("ts") >= now - F.make_dt_interval(secs=F.lit(seconds))) & (F.col("ts") <= now))


def cell_count(points: DataFrame) -> DataFrame:
    """(cells): rows times columns, as a table of text would have them."""
    return points.agg((F.count(F.lit(1)) * len(points.columns)).alias("cells"))


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([,= \\])", r"\\$1")


def as_lines(points: DataFrame) -> DataFrame:
    """(value): measurement,tag=value,... val=number nanoseconds, one line per point; commas, equal signs, spaces and backslashes in names and tags follow a backslash, a null tag is left out."""
    tags = F.concat_ws(",", _escaped(F.col("measurement")), *(F.concat(F.lit(f"{t}="), _escaped(F.col(t))) for t in TAGS))
    return points.select(F.concat(tags, F.lit(" val="), F.col("val").cast("string"), F.lit(" "), (F.unix_micros("ts") * 1000).cast("string")).alias("value"))


def from_lines(lines: DataFrame) -> DataFrame:
    """The points of as_lines; what is not such a line is an error."""
    part = r"((?:\\.|[^,= \\])*)"
    plain = lambda c: F.regexp_replace(c, r"\\(.)", "$1")
    tag = lambda t: F.when(F.col("value").rlike(rf"^(?:\\.|[^ \\])*,{t}="), plain(F.regexp_extract("value", f",{t}={part}", 1)))
    end = r" val=(\S+) (-?\d+)$"
    good = F.when(F.col("value").rlike(end), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a point: "), "value")).cast("string"))
    nanos = F.regexp_extract(good, end, 2).cast("long")
    micros = ((nanos - F.pmod(nanos, F.lit(1000))) / F.lit(1000).cast("decimal(20,0)")).cast("long")
    return lines.select(plain(F.regexp_extract("value", f"^{part}", 1)).alias("measurement"), *(tag(t).alias(t) for t in TAGS), F.timestamp_micros(micros).alias("ts"), F.regexp_extract(good, end, 1).cast("double").alias("val"))


def write_lines(points: DataFrame, path: str) -> None:
    as_lines(points).write.mode("append").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return from_lines(spark.read.text(path))


def write_csv(points: DataFrame, path: str) -> None:
    """Points as text with a header, times in microseconds since 1970, nulls as \\N."""
    points.withColumn("ts", F.unix_micros("ts")).write.mode("append").option("header", True).option("nullValue", r"\N").csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The points of write_csv."""
    schema = INDICATOR.replace("ts timestamp", "ts bigint")
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("nullValue", r"\N").csv(path).withColumn("ts", F.timestamp_micros("ts"))
