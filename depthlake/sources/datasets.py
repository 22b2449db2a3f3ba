"""Datasets at rest: partitioned parquet with a catalog of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.book import DAY
from ..operators.chunks import part_catalog
from ..operators.scan import ranked
from .scratch import stored

#: A file's bytes after compaction.
TARGET_BYTES = 256 << 20


def write_flat(rows: DataFrame, path: str, by: str = "dsID", *order: str) -> None:
    """rows as gzip parquet in a folder for each value of by; given an order, each folder's files have it, in the order of their names."""
    if order:
        rows = rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    rows.write.option("compression", "gzip").partitionBy(by).parquet(path)


def read_ordered(spark: SparkSession, *paths: str, schema: str | None = None) -> DataFrame:
    """Rows of files or folders with seq, their order: file name and row number, in place of a seq of their own."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*paths).withColumn("seq", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")))


def with_places(rows: DataFrame, by: str = "dsID") -> DataFrame:
    """rows of read_ordered with place, their number among those of their folder, from 1: what the files before hold, and the row's number in its own. Counts of files are scanned, not rows."""
    files = rows.groupBy(by, F.col("seq.file").alias("_file")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(by).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select(by, "_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return rows.withColumn("_file", F.col("seq.file")).join(before, [by, "_file"]).withColumn("place", F.col("_before") + F.col("seq.row") + 1).drop("_file", "_before")


def write_parts(parts: DataFrame, path: str) -> None:
    """Parts under path/parts by instrument and part, and their catalog under path/catalog: names of files are Spark's, so the catalog is the contract."""
    parts.repartition("instId", "part").sortWithinPartitions("timestamp").write.option("compression", "gzip").partitionBy("instId", "part").parquet(f"{path}/parts")
    part_catalog(parts.sparkSession.read.parquet(f"{path}/parts").withColumn("part", F.col("part").cast("long"))).write.parquet(f"{path}/catalog")


def parts_between(catalog: DataFrame, start: int, end: int) -> DataFrame:
    """(instId, part) of the parts that a reader of [start, end] needs: those that overlap, and the one with the last snapshot before."""
    before = catalog.where(F.col("min_timestamp") <= start).groupBy("instId").agg(F.max("part").alias("_from"))
    return catalog.join(before, "instId", "left").where((F.col("min_timestamp") <= end) & (F.col("part") >= F.coalesce("_from", F.lit(0)))).select("instId", "part")


def read_books(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Rows from which the book at any time in [start, end] follows."""
    needed = parts_between(spark.read.parquet(f"{path}/catalog"), start, end)
    return spark.read.parquet(f"{path}/parts").join(needed, ["instId", "part"], "left_semi").where(F.col("timestamp") <= end)


def list_datasets(rows: DataFrame) -> DataFrame:
    return rows.select("instId").distinct()


def by_instrument(rows: DataFrame, inst_id: str) -> DataFrame:
    return rows.where(F.col("instId") == inst_id)


def file_sizes(spark: SparkSession, path: str, by: str = "instId") -> DataFrame:
    """(by, files, bytes) of the parquet files of a dataset in folders of by; no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path", "length")
    key = F.url_decode(F.regexp_extract("path", f"/{by}=([^/]*)/", 1))
    return files.groupBy(key.alias(by)).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def compact(spark: SparkSession, path: str, out: str, by: str = "instId", order: tuple[str, ...] = ("timestamp", "seq"), target: int = TARGET_BYTES) -> None:
    """Rewrites a dataset in folders of by with files of about target bytes, each with a stretch of its folder's rows in order.

    A folder gets as many files as its bytes have targets. A row's file follows from its rank, and every file is one task's, so a large folder is many tasks and a small one is not split.
    """
    sizes = file_sizes(spark, path, by).withColumn("files", F.ceil(F.col("bytes") / target).cast("long"))
    total = sizes.agg(F.sum("files")).first()[0] or 1
    first = F.sum("files").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    sizes = stored(sizes.select(F.col(by).alias("_by"), "files", F.coalesce(first, F.lit(0)).alias("first")), "sizes")
    rows = spark.read.parquet(path)
    placed = ranked(rows, [by], order[0], "_i", DAY, distinct=False, ties=order[1:])
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    known = counts.join(sizes, F.col(by).cast("string") == F.col("_by")).select(by, "_n", "files", "first")
    told = placed.join(known, by).withColumn("_file", (F.col("first") + F.floor((F.col("_i") - 1) * F.col("files") / F.col("_n"))).cast("int"))
    dealt = told.repartitionById(int(total), "_file").sortWithinPartitions(by, *order).select(*rows.columns)
    dealt.write.option("compression", "gzip").partitionBy(by).parquet(out)
