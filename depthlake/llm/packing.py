"""Packing documents into training sequences: vector bin packing with the dot-product heuristic.

An example asks for tokens, one segment and loss-bearing tokens (all of a plain document's, those after the prompt of instruction data); a sequence has a capacity of each. Documents are cut at whole sequences, and what
remains is placed whole: the open sequence takes the example, of those that fit, with the largest dot product of its demand and
the sequence's remaining capacity, each as a share of the capacity. When none fits, a piece cut from the largest example fills the
room if the segment limit lets it. Packing runs where the rows are, task by task over blocks of rows; no row moves. A task's last sequence is
cut into powers of two, which need no padding.

Defined results: null text counts as empty and has the end id alone; ties go to the earlier row; repeated rows are packed as rows of
their own; rows with a null doc_id keep it; a null prompt is none, and one longer than the document leaves no token that bears loss; an empty table gives no piece; other columns are ignored. sequence_id is the task's number times 2^33
plus a running number, the same whenever the task runs again over the same rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, filled
from .token_files import ids_with_end

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
CAPACITY = 2048
#: Segments of a sequence: tiny documents beyond it would make the attention mask of a sequence too fragmented.
SEGMENTS = 256
#: Examples a task weighs against one another.
BLOCK = 2048


def bearing(start, length, prompt):
    """Tokens of a piece that bear loss: those after its row's prompt."""
    return length - np.clip(prompt - start, 0, length)


class Packer:
    """Places examples (row, start, tokens, prompt) in sequences; pieces holds (row, start, length, loss, sequence, offset) of closed ones.

    prompt: how many of a row's first tokens bear no loss.
    """

    def __init__(self, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int | None = None):
        self.limits = np.array([capacity, segments, capacity if loss is None else loss], np.float64)
        self.capacity = capacity
        self.rows = np.empty((0, 4), np.int64)
        self.sequences = 0
        self.pieces: list[tuple[int, int, int, int, int, int]] = []
        self._open()

    def _open(self) -> None:
        self.left, self.current = self.limits.copy(), []

    def _place(self, row: int, start: int, length: int, prompt: int) -> None:
        self.current.append((row, start, length, prompt))
        self.left -= (length, 1, bearing(start, length, prompt))

    def _close(self) -> None:
        """Numbers the open sequence; one that isn't full is cut into sequences of powers of two, which need no padding."""
        total = sum(p[2] for p in self.current)
        room = offset = 0
        for row, start, length, prompt in self.current:
            while length:
                if offset == room:
                    self.sequences += bool(room)
                    room, offset = self.capacity if total == self.capacity else 1 << (total.bit_length() - 1), 0
                    total -= room
                part = min(length, room - offset)
                self.pieces.append((row, start, part, bearing(start, part, prompt), self.sequences, offset))
                start, length, offset = start + part, length - part, offset + part
        self.sequences += bool(self.current)
        self._open()

    def add(self, row: int, tokens: int, prompt: int = 0) -> tuple[int, int, int, int] | None:
        """Places whole sequences of a document at once and returns the example that remains."""
        start = 0
        while tokens - start >= self.capacity and bearing(start, self.capacity, prompt) <= self.limits[2]:
            self.pieces.append((row, start, self.capacity, bearing(start, self.capacity, prompt), self.sequences, 0))
            self.sequences += 1
            start += self.capacity
        return (row, start, tokens - start, prompt) if tokens > start else None

    def pack(self, examples: list[tuple[int, int, int, int] | None], last: bool) -> None:
        """Packs all but a tail of the examples, or all if last."""
        rows = np.array([x for x in examples if x is not None], np.int64).reshape(-1, 4)
        rows = np.concatenate([self.rows, rows])
        demand = np.stack([rows[:, 2], np.ones(len(rows)), bearing(rows[:, 1], rows[:, 2], rows[:, 3])], 1)
        open_ = np.ones(len(rows), bool)
        scaled = demand / self.limits
        n, keep = len(rows), 0 if last else BLOCK // 4
        while n > keep:
            fits = open_ & (demand <= self.left).all(axis=1)
            if fits.any():
                best = int(np.argmax(np.where(fits, scaled @ (self.left / self.limits), -1)))
                self._place(*map(int, rows[best]))
            elif self.left.min() < 1:
                self._close()
                continue
            else:  # a piece of the largest example fills the room
                best = int(np.argmax(np.where(open_, demand[:, 0], -1)))
                row, start, length, prompt = map(int, rows[best])
                part = int(min(self.left[0], length, max(prompt - start, 0) + self.left[2]))
                self._place(row, start, part, prompt)
                rows[best] = row, start + part, length - part, prompt
                demand[best] = rows[best, 2], 1, bearing(start + part, length - part, prompt)
                scaled[best] = demand[best] / self.limits
            if fits.any() or not rows[best, 2]:
                open_[best] = False
                n -= 1
            if self.left[0] < 1:
                self._close()
        self.rows = rows[open_]
        if last and self.current:
            self._close()


def _packed(path: str, keeps_spaces: bool, segments: int, loss: int):
    def emit(pieces, held, base):
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
        if pieces:
            columns = [list(x) for x in zip(*((held[row][0], start, length, zlib.crc32(held[row][1][start : start + length]), len(held[row][1]), base + sequence, offset, loss) for row, start, length, loss, sequence, offset in pieces))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)

    def pack(batches):
        from pyspark import TaskContext

        base, packer, held, waiting, count = TaskContext.get().partitionId() << 33, Packer(segments=segments, loss=loss), {}, [], 0
        for batch in batches:
            for first, rows in slices(batch.column("text")):
                run = batch.slice(first, rows)
                ids, at = ids_with_end(filled(run.column("text")), path, keeps_spaces)
                for i, (doc_id, prompt) in enumerate(zip(run.column("doc_id").to_pylist(), run.column("prompt").to_pylist())):
                    own = ids[at[i] : at[i + 1]].astype("<u4")
                    held[count] = doc_id, own
                    waiting.append(packer.add(count, len(own), prompt))
                    count += 1
                    if len(waiting) >= BLOCK:
                        packer.pack(waiting, last=False)
                        yield from emit(packer.pieces, held, base)
                        packer.pieces, waiting = [], []
                        held = {r: held[r] for r in {*map(int, packer.rows[:, 0]), *(p[0] for p in packer.current)}}
        packer.pack(waiting, last=True)
        yield from emit(packer.pieces, held, base)

    return pack


def packed_pieces(docs: DataFrame, vocabulary: str, keeps_spaces: bool = True, segments: int = SEGMENTS, prompt: str | None = None, loss: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    prompt: a column with the number of a row's first tokens that bear no loss; without it all tokens do. loss: the loss-bearing tokens of a sequence, at most.
    """
    own = F.lit(0) if prompt is None else F.coalesce(F.col(prompt).cast("long"), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", own.cast("long").alias("prompt"))
    return rows.mapInArrow(_packed(vocabulary, keeps_spaces, segments, loss), SCHEMA)
