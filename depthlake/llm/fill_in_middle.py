"""Fill-in-the-middle transformation of whole texts, in place, and its exact inverse.

A text's bytes go into one bytearray. Its two cuts, counted in code points, are scanned to bytes; sentinels are inserted there, which gives prefix, middle and suffix in the
text's own order, each behind its sentinel; then one exchange of two neighbouring segments, by three reversals, brings them into the order of the form. The inverse finds the sentinels, exchanges the
segments back and deletes the sentinels. Every row is transformed where it is, without a shuffle; a task holds one text and its copies at a time.

Forms: psm is `<P>`prefix`<S>`suffix`<M>`middle; spm is `<S>`suffix`<P>`prefix`<M>`middle; plain is the text as it is. Cuts and form follow from the SHA-256 of a seed and the doc_id, so they are the same in every run.

Defined results: null text counts as empty and is plain; a text that contains a sentinel is plain, so the inverse is always exact; prefix, middle and suffix may be empty; rows with one
doc_id have the same hash, and cuts by their own length; a null doc_id hashes as an empty one; an empty table gives an empty result; fill_in_middle keeps all other columns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .shared import text_of

#: Seed; sentinels of prefix, suffix and middle; texts of a hundred that are transformed, and of these in a hundred those in the form spm.
SEED, PREFIX, SUFFIX, MIDDLE = 1, b"<P>", b"<S>", b"<M>"
SENTINELS, TAKEN, SPM = (PREFIX, SUFFIX, MIDDLE), 90, 20
WIDTH = len(PREFIX)
#: Bytes of text that are looked at together while code points are counted.
RUN = 1 << 16
#: Names of what is added beside columns of any name.
FORM, PREFIX_CHARS, MIDDLE_CHARS, N_CHARS = "__depthlake_form", "__depthlake_prefix_chars", "__depthlake_middle_chars", "__depthlake_n"
ADDED = [StructField(FORM, StringType()), StructField(N_CHARS, LongType()), StructField(PREFIX_CHARS, LongType()), StructField(MIDDLE_CHARS, LongType())]


def rotate(buffer: bytearray, first: int, middle: int, last: int) -> None:
    """Exchanges buffer[first:middle] and buffer[middle:last], in place: each is reversed, then both together."""
    view = np.frombuffer(buffer, np.uint8)
    for a, b in ((first, middle), (middle, last), (first, last)):
        half = (b - a) // 2
        left, right = view[a : a + half], view[b - half : b][::-1]
        left[:], right[:] = right.copy(), left.copy()


def byte_places(text: bytes, *chars: int) -> list[int]:
    """The bytes at which code points begin, by ascending number; the number of all code points is the end of the text."""
    view, out, seen, wanted = np.frombuffer(text, np.uint8), [], 0, list(chars)
    for first in range(0, len(view), RUN):
        begins = np.flatnonzero((view[first : first + RUN] & 0xC0) != 0x80)
        while wanted and wanted[0] < seen + len(begins):
            out.append(first + int(begins[wanted.pop(0) - seen]))
        seen += len(begins)
    return out + [len(text)] * len(wanted)


def code_points(text: bytes) -> int:
    view = np.frombuffer(text, np.uint8)
    return sum(int(np.count_nonzero((view[i : i + RUN] & 0xC0) != 0x80)) for i in range(0, len(view), RUN))


def drawn(doc_id: str, n: int, seed: int = SEED) -> tuple[int, int, str]:
    """Where prefix and middle end, in code points, and the form of a text of n that has no sentinel."""
    digits = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in range(0, 32, 8))
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    return first, second, "plain" if h3 % 100 >= TAKEN else "spm" if h4 % 100 < SPM else "psm"


def transformed(text: bytes, doc_id: str, seed: int = SEED) -> tuple[bytearray, str, int, int | None, int | None]:
    """A text's output, its form, its code points, and those of prefix and middle."""
    n = code_points(text)
    first, second, form = drawn(doc_id, n, seed)
    buffer = bytearray(text)
    if not text or form == "plain" or any(x in text for x in SENTINELS):
        return buffer, "plain", n, None, None
    a, b = byte_places(text, first, second)
    for at, sentinel in ((b, SUFFIX), (a, MIDDLE), (0, PREFIX)):
        buffer[at:at] = sentinel
    middle, suffix = a + WIDTH, b + 2 * WIDTH
    rotate(buffer, middle if form == "psm" else 0, suffix, len(buffer))
    return buffer, form, n, first, second - first


def restored(output: bytes, form: str) -> bytearray:
    """The text of an output in a form."""
    buffer = bytearray(output)
    if form == "plain":
        return buffer
    if form not in ("psm", "spm"):
        raise ValueError(f"no such form: {form}")
    start, own, end = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    second = buffer.find(own, WIDTH)
    third = buffer.find(end, second + WIDTH)
    if not buffer.startswith(start) or second < 0 or third < 0:
        raise ValueError(f"not an output of the form {form}")
    # the exchange undone: what stood last before it goes back behind what it was brought before
    if form == "psm":
        rotate(buffer, second, third, len(buffer))
        places = (0, second, second + len(buffer) - third)
    else:
        rotate(buffer, 0, second, len(buffer))
        places = (0, third - second, len(buffer) - second)
    for at in reversed(places):
        del buffer[at : at + WIDTH]
    return buffer


def _bytes(texts: pa.Array):
    """The texts one by one as bytes, null as empty."""
    return (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in texts)


def _output(batch: pa.RecordBatch, seed: int) -> list[pa.Array]:
    ids = ("" if x is None else str(x) for x in batch.column("doc_id").to_pylist())
    found = [transformed(text, doc_id, seed) for doc_id, text in zip(ids, _bytes(batch.column("text")))]
    texts = pa.array([bytes(x[0]) for x in found], pa.binary()).cast(pa.string())
    return [texts, pa.array([x[1] for x in found], pa.string()), *(pa.array([x[i] for x in found], pa.int64()) for i in (2, 3, 4))]


def _small(batches, most_bytes: int = 8 << 20):
    """Batches of about so many bytes at most, or of one row."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with their texts transformed, and __depthlake_form, __depthlake_n, __depthlake_prefix_chars, __depthlake_middle_chars (code points; the last two null where plain)."""

    def transform(batches):
        for batch in _small(batches):
            text, *added = _output(batch, seed)
            columns = [text if name == "text" else batch.column(name) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, *added], names=[*batch.schema.names, *(x.name for x in ADDED)])

    return docs.mapInArrow(transform, StructType([*docs.schema.fields, *ADDED]))


def restore_texts(outputs: DataFrame) -> DataFrame:
    """What fill_in_middle was given, from what it returned; a null text comes back as an empty one."""

    def restore(batches):
        for batch in _small(batches):
            texts = pa.array([bytes(restored(text, form)) for text, form in zip(_bytes(batch.column("text")), batch.column(FORM).to_pylist())], pa.binary()).cast(pa.string())
            columns = [texts if name == "text" else batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [c for c in outputs.columns if c not in {x.name for x in ADDED}]
    return outputs.mapInArrow(restore, StructType([outputs.schema[c] for c in names]))


def _digest(text: str) -> Column:
    return F.sha2(F.col(text).cast("binary"), 256)


def fill_in_middle_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256: of each row's output, and of the text rebuilt from that and its form."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    out = fill_in_middle(rows).withColumn("output_sha256", _digest("text"))
    # the text is rebuilt from the output where it is; only digests leave the task
    again = restore_texts(out.withColumns({"form": F.col(FORM), "n": F.col(N_CHARS), "prefix_chars": F.col(PREFIX_CHARS), "middle_chars": F.col(MIDDLE_CHARS)}))
    return again.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", _digest("text").alias("restored_sha256"))
