"""What the operators of this subpackage share: tables in the shared folder and chunked tokenization."""

from __future__ import annotations

import gc
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes tables of saved() that no later step reads."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def swept(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of queries that are done, which it does when its driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_of(spark: SparkSession, rows: int, each: int) -> int:
    """Tasks for so many rows, for coalesce: of about so many rows each, two for each core at least, and no more than shuffles have."""
    return max(1, min(partitions(spark), max(2 * spark.sparkContext.defaultParallelism, -(-rows // each))))


def smallest_keys(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """The rows with the smallest keys (longs from 0 up): at most so many and, where keys tell them apart, at most a hundredth fewer.

    The bound is found by histograms of 65,536 parts at most, each inside the part where the one before it ended; no rows are sorted or gathered.
    """
    low, high, bits, left = 0, None, 47, rows
    while True:
        inside = df if high is None else df.where((key >= low) & (key < high))
        for part, n in sorted(map(tuple, inside.groupBy(F.shiftright(key - F.lit(low), bits)).count().collect())):
            if n > left:
                break
            left -= n
        else:
            return df
        low += part << bits
        if not bits or left * 100 <= rows:
            return df.where(key < low)
        high, bits = low + (1 << bits), max(0, bits - 16)


# White space as Unicode's White_Space property has it; the tokenizers' \s is the same set.
WHITE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
RUNS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
# Texts for which cutting before every space and around every newline could part white space that belongs together.
KNOTTY = r"[\x00\t\r\f\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]"


def cut_before_spaces(texts: pa.Array) -> pa.ListArray:
    """Each text as chunks that a tokenizer with optional leading spaces encodes one by one as it does the whole.

    Such a tokenizer never joins a non-space character with white space after it, so a text may be cut before any run of
    white space that follows something else, and around a lone newline.
    """
    lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n\x00"), "\x00")
    knotty = pc.match_substring_regex(texts, KNOTTY)
    if pc.any(knotty).as_py():
        where = np.flatnonzero(knotty.to_numpy(zero_copy_only=False))
        slow = pa.array([RUNS.findall(texts[int(i)].as_py()) for i in where], pa.list_(pa.string()))
        order = np.arange(len(texts))
        order[where] = len(texts) + np.arange(len(where))
        lists = pa.concat_arrays([lists, slow]).take(pa.array(order))
    return lists


def cut_at_white_space(texts: pa.Array) -> pa.ListArray:
    """Each text as chunks without ASCII white space, for tokenizers that drop white space and lower-case letters.

    A-Z are lower-cased at once, which leaves fewer distinct chunks, but in texts where that could make up a special token.
    """
    return pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ... of each range, one range after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class Memory:
    """Strings and their ids, one after the other."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.flat, self.used, self.size = np.empty(1 << 16, np.uint32), 0, 0
        self.starts, self.lengths = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def add(self, strings: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, need = len(self.known), self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(need, np.uint32)])
        if n + len(strings) > len(self.starts):
            self.starts = np.concatenate([self.starts[:n], np.empty(n + len(strings), np.int64)])
            self.lengths = np.concatenate([self.lengths[:n], np.empty(n + len(strings), np.int64)])
        self.flat[self.used : need] = ids
        self.starts[n : n + len(strings)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n : n + len(strings)] = lengths
        self.known.update(zip(strings, range(n, n + len(strings))))
        self.used = need
        self.size += 220 * len(strings) + sum(map(len, strings)) + 4 * len(ids)

    def ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.lengths[slots]
        return self.flat[expand(self.starts[slots], lengths)], lengths


class Remembered:
    """Ids of strings, each distinct one encoded once while it is remembered.

    encode_new(strings) gives their places in an order of its own, their ids in that order, and how many each has. Two generations of most_bytes are kept: a string of the
    older one that is met again moves to the younger; when that is full it becomes the older one. So memory is bounded whatever the corpus, and frequent strings stay.
    """

    def __init__(self, encode_new, most_bytes: int = 64 << 20):
        self.encode_new, self.most, self.young, self.old = encode_new, most_bytes, Memory(), Memory()

    def ids(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings in one array, and how many each string has."""
        if self.young.size > self.most:
            self.young, self.old = Memory(), self.young
        coded = strings.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist takes five times as long
        slots = np.fromiter(map(self.young.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        if len(missing := np.flatnonzero(slots < 0)):
            names = list(map(distinct.__getitem__, missing.tolist()))
            earlier = np.fromiter(map(self.old.known.get, names, repeat(-1)), np.int64, len(names))
            for at, learn in ((np.flatnonzero(earlier >= 0), None), (np.flatnonzero(earlier < 0), self.encode_new)):
                own = list(map(names.__getitem__, at.tolist()))
                n = len(self.young.known)
                order, ids, lengths = learn(own) if learn else (np.arange(len(own)), *self.old.ids(earlier[at]))
                self.young.add(list(map(own.__getitem__, order.tolist())), ids, lengths)
                slots[missing[at[order]]] = n + np.arange(len(own))
        return self.young.ids(slots[coded.indices.to_numpy()] if len(distinct) else slots)


def flattened(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths


def text_bounds(lists: pa.ListArray, lengths: np.ndarray) -> np.ndarray:
    """The n+1 places where texts begin and end in the ids of their chunks, which are so many for each chunk."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return ends[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])]


def slices(texts: pa.Array, most_bytes: int = 8 << 20):
    """Runs of rows with about most_bytes of text, as (first row, rows); a longer text has a run of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    first = 0
    while first < len(texts):
        base = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, base + most_bytes, "right")))
        yield first, last - first
        first = last


def filled(texts: pa.Array) -> pa.Array:
    """A plain string array with null read as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.string()), "")


# The bytes of byte-level vocabularies as printable characters: fixed values of the file format.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    rest = [b for b in range(256) if b not in PRINTABLE]
    return {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(rest)}
