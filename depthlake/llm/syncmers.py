"""Document fingerprints from closed syncmers, with DataFrame functions alone.

A text is a sequence of units: pieces of three code points, from the beginning of each word on; a word of more than LONG code points, whose pieces would all move with an edit,
is cut into single ones, but for its last LONG. K - 1 empty units stand before and after it, so a text of any length has K-mers, and one rule serves all lengths.
Every K-mer has K - S + 1 inner S-mers; it is an anchor if the smallest hash among them is the first or the last. That depends on nothing outside the K-mer, so an edit moves no
anchor that it does not touch. Anchors are 32-bit hashes with the place of their K-mer, for positional matching. The likeness of two texts is the Dice coefficient of
all their anchors as multisets: the n-th anchor of a hash meets the n-th of the other text. The fingerprint column is a digest: the SKETCH smallest distinct hashes, 8 hex
digits each, in order; no likeness is computed from it.

The edited text of a document needs the next one's beginning. Documents are dealt to ranges of doc_id by sampled quantiles, rows of a frequent doc_id by the hash of their text as well, and each range also
gets a copy of the next range's first document, so that lead() finds the next text inside a range. Anchors are computed after that shuffle, once for each text and edited text.

Defined results: null text counts as empty; ties of doc_id are ordered by hash of the text, repeated
rows stand one after the other; rows with a null doc_id come first; of one document alone the next is itself; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import text_of

K, S = 5, 2
#: Code points of a word, or of its end, that are cut into pieces.
LONG = 24
SKETCH = 64
#: Ranges of doc_id at most, and documents that a range should hold.
RANGES, RANGE_ROWS = 50_000, 2_000
UNITS = "[^W](?=[^W]{N})|[^W]{1,3}".replace("W", "\\x20\\x09-\\x0D").replace("N", str(LONG))


def _anchors(df: DataFrame, text: str, to: str) -> DataFrame:
    """df with all anchors of a text column in column to: structs (hash, place), place the number of the K-mer's first unit, below 0 for the empty ones before the text."""
    c, h, g = F.col, f"{to}_h", f"{to}_g"
    ends = F.array(*[F.lit(0).cast("long")] * (K - 1))
    df = df.withColumn(h, F.concat(ends, F.transform(F.regexp_extract_all(c(text), F.lit(UNITS), F.lit(0)), lambda w: F.xxhash64(w)), ends))
    # inner 2-mers, then 5-mers: get() is null beyond the end, where no K-mer begins
    df = df.withColumn(g, F.transform(c(h), lambda x, i: F.xxhash64(x, F.get(c(h), i + 1))))
    kmer = lambda x, i: F.when(
        F.least(x, F.get(c(g), i + 3)) <= F.least(F.get(c(g), i + 1), F.get(c(g), i + 2)),
        F.struct(F.xxhash64(x, F.get(c(h), i + 2), F.get(c(g), i + 3)).bitwiseAND(F.lit(0xFFFFFFFF)).alias("hash"), (i - (K - 1)).cast("int").alias("place")),
    )
    inner = F.slice(F.transform(c(g), kmer), 1, F.size(g) - (K - 1))
    return df.withColumn(to, F.filter(inner, lambda x: x.isNotNull())).drop(h, g)


def _numbered(df: DataFrame, places: str, to: str) -> DataFrame:
    """df with column to: the distinct hashes of a column of anchors and, for the n-th anchor of a hash, a number of the two."""
    c, again, starts = F.col, f"{to}_again", f"{to}_starts"
    df = df.withColumn(to, F.array_sort(F.transform(c(places), lambda x: x.hash)))
    df = df.withColumn(again, F.filter(c(to), lambda x, i: x == F.get(c(to), i - 1)))
    # the runs of equal hashes among those that come again
    first = F.transform(c(again), lambda x, i: F.when(F.coalesce(x != F.get(c(again), i - 1), F.lit(True)), i))
    df = df.withColumn(starts, F.filter(first, lambda i: i.isNotNull()))
    run = lambda at, j: F.transform(F.sequence(F.lit(1), F.coalesce(F.get(c(starts), j + 1), F.size(again)) - at), lambda n: F.xxhash64(F.get(c(again), at), n))
    return df.withColumn(to, F.concat(F.array_distinct(c(to)), F.flatten(F.transform(c(starts), run)))).drop(again, starts)


def anchored(df: DataFrame, text: str, to: str) -> DataFrame:
    """df with the anchors of a text column as distinct numbers in column to, and their digest in to_print."""
    df = _numbered(_anchors(df, text, f"{to}_places"), f"{to}_places", to)
    return df.withColumn(f"{to}_print", fingerprint_text(F.transform(f"{to}_places", lambda x: x.hash))).drop(f"{to}_places")


def fingerprint_text(hashes: Column) -> Column:
    """The SKETCH smallest distinct hashes: a short digest, which no likeness is computed from."""
    return F.array_join(F.transform(F.slice(F.array_sort(F.array_distinct(hashes)), 1, SKETCH), lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The Dice coefficient of two arrays of distinct numbers."""
    return 2 * F.size(F.array_intersect(a, b)).cast("double") / (F.size(a) + F.size(b))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns places, all anchors of the text in its order as structs (hash, place), and anchors, the numbers that likeness compares."""
    return _numbered(_anchors(docs, text, "places"), "places", "anchors")


def _count_of(bounds: list[int], value: Column, equal: bool) -> Column:
    """How many of the sorted bounds are below the value, or equal to it too, by binary search."""
    steps = [1 << b for b in range(len(bounds).bit_length() - 1, -1, -1)]
    held = F.lit(bounds) if bounds else F.array().cast("array<long>")
    below = lambda p: F.get(held, p - 1) <= value if equal else F.get(held, p - 1) < value
    return F.aggregate(F.lit(steps), F.lit(0), lambda p, b: F.when(F.coalesce(below(p + b), F.lit(False)), p + b).otherwise(p)) if bounds else F.lit(0)


def with_ranges(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and more) with tie, which orders the rows of a doc_id, and range, which ascends with doc_id and tie and holds some RANGE_ROWS rows."""
    # one pass over doc_id: quantiles by sketch
    rows = docs.count()
    ranges = max(1, min(RANGES, -(-rows // RANGE_ROWS)))
    least = F.lit(-(1 << 63))
    own = F.coalesce("doc_id", least)
    bounds = docs.agg(F.percentile_approx(own, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 and rows else []
    docs = docs.withColumn("tie", F.shiftrightunsigned(F.xxhash64("text"), 11))
    share = F.col("tie") / F.lit(float(1 << 53))
    share = F.when(F.col("doc_id").isNull(), share / 2).when(F.col("doc_id") == least, 0.5 + share / 2).otherwise(share)
    low, high = _count_of(bounds, own, False), _count_of(bounds, own, True)
    return docs.withColumn("range", (low + F.floor(share * (high - low + 1))).cast("long"))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) by range, and the first row of the next range once more (copy): after the last range comes the first."""
    ranged = with_ranges(docs)
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")
    # at most RANGES + 1 rows: each range's first place, and the range before it
    firsts = ranged.groupBy("range").agg(F.min(place).alias("place"))
    ends = Window.orderBy("range")
    before = F.coalesce(F.lag("range").over(ends), F.max("range").over(ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    bounds = firsts.select("range", "place", before.alias("before"))
    copies = ranged.join(F.broadcast(bounds), "range").where(place == F.col("place")).groupBy(F.col("before").alias("range")).agg(F.min("text").alias("text"))
    copies = copies.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("tie"), "range", F.lit(True).alias("copy"))
    return ranged.withColumn("copy", F.lit(False)).unionByName(copies)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = anchored(with_next(own).repartition("range"), "text", "own")
    w = Window.partitionBy("range").orderBy("copy", "doc_id", "tie", "text")
    pairs = rows.select("*", F.lead("text").over(w).alias("next_text"), F.lead("own").over(w).alias("next")).where(~F.col("copy"))
    pairs = pairs.withColumn("n_chars", F.length("text"))
    tail = F.floor(F.col("n_chars") / 4).cast("int")
    pairs = pairs.withColumn("edited", F.concat(F.expr("left(text, n_chars - cast(floor(n_chars / 4) as int))"), F.substring(F.col("next_text"), F.lit(1), tail)))
    pairs = anchored(pairs, "edited", "new")
    c = F.col
    return pairs.select(
        "doc_id",
        c("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        c("own_print").alias("fingerprint"),
        c("new_print").alias("edited_fingerprint"),
        likeness(c("own"), c("new")).alias("near_edited"),
        likeness(c("own"), c("next")).alias("near_next"),
    )
