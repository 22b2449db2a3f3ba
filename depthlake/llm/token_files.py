"""Token files: Parquet list columns of token ids in ascending doc_id order.

The table is range-partitioned by doc_id and sorted before encoding, so each file holds a run of ids in order. ids is a list column with a
dictionary (a vocabulary's ids fit one dictionary page), doc_id, n_tokens and file_start are delta-encoded (data pages of version 2),
row groups and pages are small and indexed, so a reader can fetch the metadata columns alone or the pages of a few documents.

Defined results: null text counts as empty and has the end id alone; rows with a null doc_id come first; ties of doc_id keep
one place each, ordered by text; an empty table writes an empty file; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from .shared import filled, partitions, slices
from .vocabularies import encoder

SCHEMA = "doc_id long, part int, file_start long, n_tokens int, ids array<int>"
#: Bytes of a row group and of a page, and rows of a page: small enough that a point read fetches little.
ROW_GROUP, PAGE, PAGE_ROWS = 16 << 20, 256 << 10, 2_000
#: Documents of a file.
FILE_ROWS = 250_000
#: The id after each document.
END_ID = 1


def ids_with_end(texts: pa.Array, path: str, keeps_spaces: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts with END_ID after each, and the n+1 places where texts begin and end."""
    ids, at = encoder(path, keeps_spaces).encode(texts)
    return np.insert(ids, at[1:], END_ID), at + np.arange(len(at))


def _encoded(path: str, keeps_spaces: bool):
    def encode(batches):
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, rows in slices(batch.column("text")):
                run = batch.slice(first, rows)
                ids, at = ids_with_end(filled(run.column("text")), path, keeps_spaces)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32, copy=False)))
                yield pa.RecordBatch.from_arrays([run.column("doc_id"), pa.array(np.full(rows, part, np.int32)), pa.array(start + at[:-1]), pa.array(np.diff(at), pa.int32()), lists], names=["doc_id", "part", "file_start", "n_tokens", "ids"])
                start += int(at[-1])

    return encode


def write_token_files(docs: DataFrame, vocabulary: str, keeps_spaces: bool, path: str | None = None) -> str:
    """Writes the files and returns their folder."""
    spark = docs.sparkSession
    path = path or scratch(spark, "token-files")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(max(partitions(spark), -(-docs.count() // FILE_ROWS)), "doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(_encoded(vocabulary, keeps_spaces), SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", str(ROW_GROUP))
        .option("parquet.page.size", str(PAGE))
        .option("parquet.page.row.count.limit", str(PAGE_ROWS))
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .parquet(path)
    )
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids. A select of fewer columns reads only theirs."""
    files = spark.read.schema(SCHEMA).parquet(path)
    # one row per file: bounded by the number of files, not of documents
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    return files.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("file_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def _checksums(batches):
    for batch in batches:
        lists = batch.column("ids")
        values, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers, from files as read back."""
    return files.mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
