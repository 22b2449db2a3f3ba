"""Removal of repeated passages by a sparse suffix array over content-defined anchors.

A byte goes if a LENGTH-byte string (a window) that covers it also starts earlier in the corpus. Of each window the GRAM with the smallest hash is its anchor, so equal
windows have their anchor at the same place. The suffixes that start at anchors, with the bytes before them, stand for all windows around them:

1. Anchors are found where the texts are. Within a task's run of texts, an anchor whose whole context (all bytes of all windows that it could have) is the same, byte by
   byte, as an earlier one's is settled there: this takes the mass out of hot copies and of texts of one letter.
2. Anchors are range-partitioned by the hash of their gram; those whose gram comes once in the corpus leave, as nothing can equal their windows.
3. The suffixes of the others are range-partitioned by their bytes (then the bytes before them, then place) with sampled splitters. Each bucket sorts them by a multikey quicksort over
   8-byte words, forwards and backwards, which gives the lengths of common prefixes on both sides. A window with k bytes before its anchor is equal to
   another if both have the same first 100 - k bytes after and k before; all but the first of equals are repeats, given out as ranges.
4. Only windows whose bytes after the anchor are also those of the bucket's first or last suffix can have an equal in another bucket. The first ones of them are dealt once more, now by the bytes
   before the anchor; those that are still open at a boundary of such a bucket, which shares both sides, are compared by their whole bytes, one row of a bucket for each distinct window.
5. The ranges of window starts meet the texts again, which cut what the windows cover.

Hashes only choose candidates; what settles a window is a comparison of all its bytes.

Defined results: null text counts as empty; texts shorter than LENGTH bytes stay whole; rows of one doc_id are ordered by text, and repeated rows repeat the first;
a null doc_id orders before all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, expand, filled, partitions, saved, slices

LENGTH, GRAM = 100, 24
#: Grams of a window, and bytes before an anchor that its windows may reach.
GRAMS = LENGTH - GRAM + 1
REACH = GRAMS - 1
#: Bytes whose hashes are in memory at once, and bytes of text whose anchors a task settles together.
TILE, TOGETHER = 1 << 19, 1 << 24
PLACE = np.uint64((1 << 23) - 1)
C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * C1
    x += b * C2
    x ^= x >> np.uint64(31)
    return x


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * C2
    x ^= x >> np.uint64(29)
    x *= C1
    x ^= x >> np.uint64(32)
    return x


def _doubled(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of runs twice as long; the last ones, which reach beyond the end, are left out."""
    return _joined(h[:-step], h[step:])


def tile_anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, last: int):
    """Anchors of the windows that start in [first, last) of raw, which holds texts from starts to ends one after the other.

    Returns place, low, high (the windows that it anchors), gram hash and context hash. raw reaches as far as those windows and contexts do.
    """
    none = np.empty(0, np.int64)
    n = len(raw)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    padded = np.concatenate([raw, np.zeros(128, np.uint8)]).astype(np.uint64)
    padded += np.uint64(1)
    h8 = _doubled(_doubled(_doubled(padded * C1, 1), 2), 4)
    h16 = _doubled(h8, 8)
    grams = _joined(h16[: n - GRAM + 1], h8[16 : 16 + n - GRAM + 1])
    h128 = _doubled(_doubled(_doubled(h16, 16), 32), 64)[:n]
    key = (_mixed(grams) & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    low = key
    for step in (1, 2, 4, 8, 16, 32):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[: n - LENGTH + 1], low[GRAMS - 64 : GRAMS - 64 + n - LENGTH + 1])
    text = np.repeat(np.arange(len(starts)), np.maximum(np.minimum(ends - LENGTH + 1, last) - np.maximum(starts, first), 0))
    windows = expand(np.maximum(starts, first), np.maximum(np.minimum(ends - LENGTH + 1, last) - np.maximum(starts, first), 0))
    if not len(windows):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = (low[windows] & PLACE).astype(np.int64)
    change = np.flatnonzero((at[1:] != at[:-1]) | (text[1:] != text[:-1])) + 1
    begin = np.concatenate([[0], change])
    end = np.concatenate([change, [len(at)]]) - 1
    place, text = at[begin], text[begin]
    left, right = np.maximum(place - REACH, starts[text]), np.minimum(place + LENGTH, ends[text])
    whole = (left == place - REACH) & (right == place + LENGTH)
    context = np.empty(len(place), np.uint64)
    context[whole] = _mixed(_joined(h128[left[whole]], h128[right[whole] - 128]))
    data = raw.tobytes()
    for i in np.flatnonzero(~whole):  # next to a text's beginning or end; how much is cut off is part of the context
        digest = hashlib.blake2b(data[left[i] : right[i]], digest_size=8, salt=bytes([place[i] - left[i], right[i] - place[i]])).digest()
        context[i] = int.from_bytes(digest, "little")
    return place, windows[begin], windows[end], grams[place], context


def text_anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Anchors of all texts in raw: text, place, low, high (relative to the text), gram hash, context hash."""
    found = []
    for a, b in _tiles(starts, ends):
        if a + 1 < b or ends[a] - starts[a] <= TILE:
            base = starts[a]
            place, low, high, g, c = tile_anchors(raw[base : ends[b - 1]], starts[a:b] - base, ends[a:b] - base, 0, int(ends[b - 1] - base))
            text = a + np.searchsorted(ends[a:b] - base, place, "right")
            found.append((text, place + base - starts[text], low + base - starts[text], high + base - starts[text], g, c))
            continue
        size = int(ends[a] - starts[a])
        parts = []
        for first in range(0, size, TILE):
            # a window's anchor lies up to REACH bytes further, and its context as much around that
            base = max(0, first - REACH)
            top = min(size, first + TILE + 2 * LENGTH + REACH)
            own = raw[starts[a] + base : starts[a] + top]
            place, low, high, g, c = tile_anchors(own, np.array([0]), np.array([len(own)]), first - base, min(first + TILE, size) - base)
            parts.append((np.full(len(place), a), place + base, low + base, high + base, g, c))
        text, place, low, high, g, c = (np.concatenate(x) for x in zip(*parts))
        same = np.concatenate([[False], place[1:] == place[:-1]])  # an anchor with windows in two tiles
        keep = np.flatnonzero(~same)
        high = np.maximum.reduceat(high, keep) if len(keep) else high
        found.append((text[keep], place[keep], low[keep], high, g[keep], c[keep]))
    if not found:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2
    return tuple(np.concatenate(x) for x in zip(*found))


def _tiles(starts: np.ndarray, ends: np.ndarray):
    """Runs of texts of TILE bytes at most; a longer text has a run of its own."""
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + TILE, "right")))
        yield a, b
        a = b


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if texts.buffers()[2] else np.empty(0, np.uint8)
    return raw, at[:-1] - at[0], at[1:] - at[0]


ANCHORS = "gram long, doc long, place long, low long, high long"


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names.split())


def runs(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of starts that touch, joined per document."""
    order = np.lexsort((low, doc))
    doc, low, high = doc[order], low[order], high[order]
    if not len(doc):
        return doc, low, high
    begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (low[1:] > high[:-1] + 1)]))
    return doc[begin], low[begin], np.maximum.reduceat(high, begin)


def _same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether raw has the same size bytes at a and at b."""
    out = np.empty(len(a), bool)
    for first in range(0, len(a), 1 << 14):
        x, y, n = (v[first : first + (1 << 14)] for v in (a, b, size))
        equal = raw[expand(x, n)] == raw[expand(y, n)]
        out[first : first + (1 << 14)] = np.logical_and.reduceat(equal, np.cumsum(n) - n) if len(n) else True
    return out


def _settled_locally(raw, base, end, doc, place, low, high, g, c):
    """Rows of ANCHORS: first anchors of each context, and ranges of window starts that earlier ones settle (gram null).

    raw: the bytes of all texts of the run; base, end: where each anchor's text begins and ends there.
    """
    order = np.lexsort((place, doc, c, g))
    again = np.zeros(len(order), bool)
    again[1:] = (g[order[1:]] == g[order[:-1]]) & (c[order[1:]] == c[order[:-1]])
    first = order[np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))]
    rest, first = order[again], first[again]
    left = np.minimum(place, REACH)
    size = left + np.minimum(LENGTH, end - base - place)
    same = (left[rest] == left[first]) & (size[rest] == size[first])
    rest, first = rest[same], first[same]
    rest = rest[_same_bytes(raw, (base + place - left)[rest], (base + place - left)[first], size[rest])]
    stay = np.ones(len(doc), bool)
    stay[rest] = False
    gone = runs(doc[rest], low[rest], high[rest])
    stay = np.flatnonzero(stay)
    gram = pa.array(np.concatenate([g[stay].view(np.int64), np.zeros(len(gone[0]), np.int64)]), mask=np.arange(len(stay) + len(gone[0])) >= len(stay))
    return _batch("gram doc place low high", gram, *(np.concatenate(x).astype(np.int64) for x in zip((doc[stay], place[stay], low[stay], high[stay]), (gone[0], gone[1], gone[1], gone[2]))))


def _anchors(batches):
    held, raws, size = [], [], 0

    def settled():
        return _settled_locally(np.concatenate(raws), *(np.concatenate(x) for x in zip(*held)))

    for batch in batches:
        for first, rows in slices(batch.column("text"), 1 << 20):
            run = batch.slice(first, rows)
            raw, starts, ends = _bytes_of(filled(run.column("text")))
            text, *found = text_anchors(raw, starts, ends)
            held.append((starts[text] + size, ends[text] + size, run.column("doc").to_numpy()[text], *found))
            raws.append(raw)
            size += len(raw)
            if size >= TOGETHER:
                yield settled()
                held, raws, size = [], [], 0
    if held:
        yield settled()


def _shared_grams(batches):
    """Of a range of anchors by gram those whose gram comes again; those of its first and last gram stay too, as other ranges may have them."""
    held = [b for b in batches if b.num_rows]
    if held:
        gram, doc, place, low, high = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("gram", "doc", "place", "low", "high"))
        order = np.argsort(gram, kind="stable")
        g = gram[order]
        same = g[1:] == g[:-1]
        keep = np.zeros(len(g), bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep |= (g == g[0]) | (g == g[-1])
        at = order[keep]
        yield _batch("doc place low high", doc[at], place[at], low[at], high[at])


SUFFIXES = "doc long, place long, low long, high long, after binary, before binary"


def _suffixes(batches):
    """The bytes of each open anchor of the texts: those after it, and those before it backwards, as far as its windows go."""
    for batch in batches:
        rows, after, before = [], [], []
        for doc, text, open_ in zip(batch.column("doc").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("open").to_pylist()):
            back, n = text[::-1], len(text)
            for x in open_:
                place, low, high = x["place"], x["low"], x["high"]
                rows.append((doc, place, low, high))
                after.append(text[place : high + LENGTH])
                before.append(back[n - place : n - low])
            if len(rows) > 10_000:
                yield _batch("doc place low high after before", *np.array(rows, np.int64).T, pa.array(after, pa.binary()), pa.array(before, pa.binary()))
                rows, after, before = [], [], []
        yield _batch("doc place low high after before", *np.array(rows, np.int64).reshape(-1, 4).T, pa.array(after, pa.binary()), pa.array(before, pa.binary()))


def table_of(column: pa.Array, width: int) -> np.ndarray:
    """Byte strings as rows of a table, filled up with zeros to a multiple of 8."""
    raw, starts, ends = _bytes_of(column)
    out = np.zeros((len(column), -(-width // 8) * 8), np.uint8)
    out[np.arange(out.shape[1]) < (ends - starts)[:, None]] = raw
    return out


def multikey_order(table: np.ndarray) -> np.ndarray:
    """The order of the rows of a table of bytes, by a multikey quicksort over 8-byte words.

    Word by word: rows are sorted by group and word, runs of equals are the next groups, and rows that are alone have their place.
    """
    words = table.view(">u8")
    order, at, group = np.arange(len(words)), np.arange(len(words)), np.zeros(len(words), np.int64)  # places still open, and the group of each
    for w in range(words.shape[1]):
        key = words[order[at], w].astype(np.uint64)
        by = np.lexsort((key, group)) if w else np.argsort(key, kind="stable")
        order[at], key, group = order[at[by]], key[by], group[by]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])]) if len(at) else np.empty(0, bool)
        number = np.cumsum(new) - 1
        many = np.bincount(number, minlength=1)[number] > 1
        at, group = at[many], number[many]
    return order


def common_prefixes(table: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The bytes that each row shares with the one before it in order: 0 for the first, LENGTH for equal rows."""
    out = np.zeros(len(order), np.int64)
    for first in range(1, len(order), 1 << 14):
        at = order[first - 1 : first + (1 << 14)]
        other = table[at[1:]] != table[at[:-1]]
        out[first : first + len(other)] = np.where(other.any(axis=1), other.argmax(axis=1), LENGTH)
    return out


class Sorted:
    """A side (bytes after or before) of a bucket's suffixes in order."""

    def __init__(self, table: np.ndarray):
        self.order = multikey_order(table)
        self.common = common_prefixes(table, self.order)
        self.rank = np.empty(len(table), np.int64)
        self.rank[self.order] = np.arange(len(table))

    def shared(self) -> np.ndarray:
        """The most bytes that each row shares with any other."""
        return np.maximum(self.common, np.append(self.common[1:], 0))[self.rank]

    def with_ends(self) -> np.ndarray:
        """The most bytes that each row shares with the first or the last row."""
        if not len(self.order):
            return self.common
        first = np.minimum.accumulate(np.append(LENGTH, self.common[1:]))
        last = np.minimum.accumulate(np.append(LENGTH, self.common[:0:-1]))[::-1]
        return np.maximum(first, last)[self.rank]

    def classes(self, size: int) -> np.ndarray:
        """A number for each row that rows with the same first size bytes share."""
        return np.cumsum(self.common < size)[self.rank]


FOUND = "doc long, place long, low long, high long, after binary, before binary, window binary"
#: Suffixes that a bucket should hold, some 20 MB, anchors that a range by gram should hold, 40 MB, and windows that a suffix can have.
BUCKET_ROWS, RANGE_ROWS, WINDOWS = 100_000, 1_000_000, np.arange(REACH + 1)


def repeats(after: Sorted, before: Sorted, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """A table of flags: whether an earlier row has the row's window with k bytes before the anchor too. Rows are in order of place; k goes from least to most."""
    out = np.zeros((len(least), len(WINDOWS)), bool)
    # rows that equal an earlier one in everything leave at once
    whole = [after.classes(LENGTH), before.classes(LENGTH), least, most]
    order = np.lexsort(whole)
    copies = order[1:][np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in whole])]
    out[copies] = (least[copies, None] <= WINDOWS) & (WINDOWS <= most[copies, None])
    alone = np.ones(len(least), bool)
    alone[copies] = False
    low, high = np.maximum(least, LENGTH - after.shared()), np.minimum(most, before.shared())
    live = np.flatnonzero(alone & (low <= high))
    low, high = low[live], high[live]
    for k in range(int(low.min(initial=LENGTH)), int(high.max(initial=-1)) + 1):
        rows = live[(low <= k) & (k <= high)]
        key = after.classes(LENGTH - k)[rows] * (len(least) + 1) + before.classes(k)[rows]
        out[np.delete(rows, np.unique(key, return_index=True)[1]), k] = True
    return out


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flags in a row: the row, the first and the last column."""
    edges = np.diff(np.pad(flags, ((0, 0), (1, 1))).view(np.int8), axis=1)
    row, first = np.nonzero(edges > 0)
    return row, first, np.nonzero(edges < 0)[1] - 1


def _sorted_bucket(by_before: bool):
    """Repeats inside a bucket as ranges, and first windows that may have an equal in another bucket as they share what the bucket is dealt by with its
    first or last suffix: as suffixes with those windows alone or, of a bucket dealt by the bytes before, window by window."""
    names = "doc place low high after before window"

    def sort(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        rows = rows.take(pc.sort_indices(rows, [("doc", "ascending"), ("place", "ascending")])).combine_chunks().to_batches()[0]
        doc, place, low, high = (rows.column(c).to_numpy() for c in ("doc", "place", "low", "high"))
        tables = [table_of(rows.column("after"), LENGTH), table_of(rows.column("before"), REACH)]
        after, before = map(Sorted, tables)
        least, most = place - high, place - low
        again = repeats(after, before, least, most)
        row, first, last = spans(again)
        d, a, b = runs(doc[row], place[row] - last, place[row] - first)
        none = pa.nulls(len(d), pa.binary())
        yield _batch(names, d, a, a, b, none, none, none)

        if by_before:
            most = np.minimum(most, before.with_ends())
        else:
            least = np.maximum(least, LENGTH - after.with_ends())
        open_ = ~again & (least[:, None] <= WINDOWS) & (WINDOWS <= most[:, None])
        row, first, last = spans(open_)
        if by_before:
            row, first = np.nonzero(open_)
            last = first
        for at in range(0, len(row), 1 << 14):
            r, x, y = (v[at : at + (1 << 14)] for v in (row, first, last))
            forth = [tables[0][i, : LENGTH - k].tobytes() for i, k in zip(r, x)]
            back = [tables[1][i, :k].tobytes() for i, k in zip(r, y)]
            none = [None] * len(r)
            own = (none, none, [b[::-1] + f for f, b in zip(forth, back)]) if by_before else (forth, back, none)
            yield _batch(names, doc[r], place[r], place[r] - y, place[r] - x, *(pa.array(v, pa.binary()) for v in own))

    return sort


def _bucketed(suffixes: DataFrame, by_before: bool) -> DataFrame:
    """Rows of FOUND from a saved table of suffixes."""
    buckets = max(partitions(suffixes.sparkSession), -(-suffixes.count() // BUCKET_ROWS))
    sides = ("before", "after") if by_before else ("after", "before")
    return saved(suffixes.repartitionByRange(buckets, *sides, "doc", "place").mapInArrow(_sorted_bucket(by_before), FOUND), "found")


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """(doc, low, high): ranges of starts of windows that also start earlier, of a table (doc, text) with distinct doc."""
    anchors = saved(texts.mapInArrow(_anchors, ANCHORS), "anchors")
    grams = anchors.where("gram is not null")
    ranges = max(partitions(texts.sparkSession), -(-grams.count() // RANGE_ROWS))
    by_gram = grams.repartitionByRange(ranges, "gram", "doc", "place")
    shared = by_gram.mapInArrow(_shared_grams, "doc long, place long, low long, high long")
    open_ = shared.groupBy("doc").agg(F.collect_list(F.struct("place", "low", "high")).alias("open"))
    suffixes = saved(texts.join(open_, "doc").select("doc", "text", "open").mapInArrow(_suffixes, SUFFIXES), "suffixes")
    found = _bucketed(suffixes, by_before=False)
    dropped(suffixes)
    across = _bucketed(found.where("after is not null").select("doc", "place", "low", "high", "after", "before"), by_before=True)
    windows = across.where("window is not null").select("doc", "low", "window")
    firsts = windows.groupBy("window").agg(F.min(F.struct("doc", "low")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = windows.join(firsts, "window").where(F.struct("doc", "low") > F.col("first")).select("doc", "low", F.col("low").alias("high"))
    inside = [df.select("doc", "low", "high") for df in (anchors.where("gram is null"), found.where("after is null"), across.where("window is null"))]
    ranges = saved(inside[0].union(inside[1]).union(inside[2]).union(later), "ranges")
    dropped(anchors, found, across)
    return ranges


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _cut(keeps_text: bool):
    def cut(batches):
        for batch in batches:
            out = []
            for doc_id, text, ranges in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                raw, kept, at, removed, spans = text.encode(), [], 0, 0, 0
                end = -1
                for low, high in sorted((x["low"], x["high"]) for x in ranges or ()):
                    if low > end:
                        spans += 1
                        kept.append(raw[at:low])
                        removed -= low
                        removed += high + LENGTH
                    elif high + LENGTH > end:
                        removed += high + LENGTH - end
                    end = max(end, high + LENGTH)
                    at = end
                kept.append(raw[at:])
                kept = b"".join(kept)
                out.append((doc_id, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace") if keeps_text else None))
            columns = list(zip(*out)) or [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return cut


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, text): doc is distinct and orders rows by doc_id, null first, and text. It is doc_id itself where that is distinct and never null."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return rows.withColumn("doc", F.col("doc_id"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "text").sortWithinPartitions("doc_id", "text")
    return saved(ordered.withColumn("doc", F.monotonically_increasing_id()), "numbered")


def remove_repeats(docs: DataFrame, keeps_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (a cut inside a character leaves U+FFFD)."""
    texts = numbered(docs)
    ranges = repeated_ranges(texts.select("doc", "text")).groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    cut = texts.join(ranges, "doc", "left").select("doc_id", "text", "ranges").mapInArrow(_cut(keeps_text), CUT)
    return cut if keeps_text else cut.drop("kept")
