"""BPE encoding and decoding with a minimal acyclic transducer for frequent words and exact merges for the rest.

Spark counts the words of the whole corpus (chunks between places where a byte-level tokenizer never joins) and keeps the LEXICON most
frequent, a bounded table. They are compiled into a minimal acyclic automaton: equal suffixes share states, and each arc carries the number
of words before it, so the sum along a word is its number, which finds its ids. Workers map the compiled arrays into memory and look up the
distinct words of a batch together, byte by byte. Words that the automaton does not accept are merged pair by pair by rank, as the vocabulary file says,
many short words at a time; a long word in a time that grows as its length times the logarithm of the ranks.

Defined results: null text counts as empty and has no ids; special tokens in a text are their ids, as the library has it; repeated rows are encoded each;
rows with a null doc_id keep it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_letters, cut_before_spaces, dropped, expand, filled, saved, slices, smallest_keys, text_bounds
from .vocabularies import ChunkEncoder

#: Words compiled into the automaton, at most.
LEXICON = 40_000
#: Bytes of a word that is looked up; longer ones are merged.
LONGEST = 40
#: Bytes of a word beyond which it is merged rank by rank.
LONG = 200
NONE = np.iinfo(np.int32).max


class Merges:
    """A byte-level vocabulary file: its merges, special tokens and the bytes of its ids."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        vocab, bytes_of = held["model"]["vocab"], {c: b for b, c in byte_letters().items()}
        raw = [b""] * (1 + max([*vocab.values(), *(x["id"] for x in held["added_tokens"])]))
        for token, i in vocab.items():
            raw[i] = bytes(bytes_of[c] for c in token)
        self.special = {x["content"]: x["id"] for x in held["added_tokens"]}
        for token, i in self.special.items():
            raw[i] = token.encode()
        self.parts = regex.compile(public_tokenizers.PATTERN)
        self.specials = regex.compile(f"({'|'.join(map(regex.escape, self.special)) or '(?!)'})")
        self.raw, self.base = np.frombuffer(b"".join(raw), np.uint8), len(raw)
        self.raw_lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        self.raw_starts = np.cumsum(self.raw_lengths) - self.raw_lengths
        self.of_byte = np.array([vocab[c] for _, c in sorted(byte_letters().items())], np.int32)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in held["model"]["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.sides = [(vocab[a], vocab[b]) for a, b in pairs]
        self.rank_of = {a * self.base + b: rank for rank, (a, b) in enumerate(self.sides)}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where there is none or a side is padding (-1)."""
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words, each by its lowest-ranked leftmost pair again and again. Words of like length go together."""
        out = [self._merge_long(x) if len(x) > LONG else [] for x in words]
        order = sorted((i for i in range(len(words)) if len(words[i]) <= LONG), key=lambda i: len(words[i]))
        first = 0
        while first < len(order):
            length = max(1, len(words[order[first]]))
            last = first + 1
            while last < len(order) and len(words[order[last]]) <= length + length // 2 + 2 and last - first < (1 << 20) // length:
                last += 1
            self._merge([words[i] for i in order[first:last]], order[first:last], out)
            first = last
        return out

    def _merge(self, words: list[bytes], to: list[int], out: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        width = int(lengths.max(initial=0)) + 1
        ids = np.full((len(words), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        rank, rows, columns = self.rank(ids[:, :-1], ids[:, 1:]), np.arange(len(words)), np.arange(width)
        rank = np.concatenate([rank, np.full((len(words), 1), NONE, np.int32)], axis=1)
        held = ids.copy()
        while len(rows):
            best = rank.argmin(axis=1)
            low = rank[np.arange(len(rows)), best]
            ended = low == NONE
            if ended.any():
                held[rows[ended]] = ids[ended]
                ids, rank, rows, best, low = ids[~ended], rank[~ended], rows[~ended], best[~ended], low[~ended]
                if not len(rows):
                    break
            k = np.arange(len(rows))
            ids[k, best] = self.made[low]
            ids = np.take_along_axis(ids, np.minimum(columns + (columns > best[:, None]), width - 1), 1)
            rank = np.take_along_axis(rank, np.minimum(columns + (columns >= best[:, None]), width - 1), 1)
            rank[k, best] = self.rank(ids[k, best], ids[k, np.minimum(best + 1, width - 1)])
            before = np.flatnonzero(best > 0)
            rank[before, best[before] - 1] = self.rank(ids[before, best[before] - 1], ids[before, best[before]])
        for i, row in zip(to, held.tolist()):
            out[i] = row[: row.index(-1)] if -1 in row else row

    def _merge_long(self, word: bytes) -> list[int]:
        """Ids of one word: ranks in ascending order, and all places of a rank from left to right, in a list linked both ways."""
        start = self.of_byte[np.frombuffer(word, np.uint8)]
        ranks = self.rank(start[:-1], start[1:])
        by_rank = np.argsort(ranks, kind="stable")
        by_rank = by_rank[: int(np.searchsorted(ranks[by_rank], NONE))]
        cuts = np.flatnonzero(np.diff(ranks[by_rank])) + 1
        places = {int(ranks[own[0]]): own.tolist() for own in np.split(by_rank, cuts) if len(own)}
        heap = sorted(places)
        ids, n = start.tolist(), len(start)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        made_by, base, rank_of = self.made.tolist(), self.base, self.rank_of
        while heap:
            rank = heapq.heappop(heap)
            left, right = self.sides[rank]
            made, todo = made_by[rank], sorted(places.pop(rank))
            for at, i in enumerate(todo):
                k = after[i]
                if ids[i] != left or k == n or ids[k] != right:
                    continue
                ids[i], ids[k] = made, -1
                after[i] = far = after[k]
                near, lower = before[i], False
                pairs = []
                if far < n:
                    before[far] = i
                    pairs.append((i, made * base + ids[far]))
                if near >= 0:
                    pairs.append((near, ids[near] * base + made))
                for place, key in pairs:
                    new = rank_of.get(key)
                    if new is not None:
                        lower |= new < rank
                        if new in places:
                            places[new].append(place)
                        else:
                            places[new] = [place]
                            heapq.heappush(heap, new)
                if lower and at + 1 < len(todo):  # a pair of lower rank goes before the places that are left
                    if rank not in places:
                        heapq.heappush(heap, rank)
                    places.setdefault(rank, []).extend(todo[at + 1 :])
                    break
        return [x for x in ids if x >= 0]

    def split(self, chunk: str) -> list[str]:
        """The words of a chunk, as the vocabulary's pattern cuts them; a special token is a word."""
        out = []
        for piece in self.specials.split(chunk):
            out += [piece] if piece in self.special else self.parts.findall(piece)
        return out

    def encode(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks without the automaton."""
        parts = [self.split(x) for x in chunks]
        distinct = {x: None for own in parts for x in own if x not in self.special}
        known = dict(zip(distinct, self.merge([x.encode() for x in distinct]))) | {x: [i] for x, i in self.special.items()}
        return [known[own[0]] if len(own) == 1 else [i for x in own for i in known[x]] for own in parts]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The decoded text of each run of ids, in UTF-8, with what is not UTF-8 replaced."""
        lengths = self.raw_lengths[ids]
        blob = self.raw[expand(self.raw_starts[ids], lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[at]
        out = [blob[a:b] for a, b in zip(ends[:-1], ends[1:])]
        try:
            blob.decode()
        except UnicodeDecodeError:
            out = [x.decode(errors="replace").encode() for x in out]
        return out


def compile_words(words: list[bytes], ids: list[list[int]]) -> dict[str, np.ndarray]:
    """A minimal acyclic automaton of distinct words and its outputs, as arrays.

    next[state, class] is the state after a byte, 0 for none (state 0 is dead, 1 is the start); before[state, class]
    the number of accepted words that come before the arc's; ends[state] whether a word ends there. Words enter in byte
    order, and a state that gets no more arcs is replaced by an equal one that exists.
    """
    order = sorted(range(len(words)), key=lambda i: words[i])
    arcs: list[dict[int, int]] = [{}, {}]
    final = [False, False]
    known: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # (state, byte) of the last word's arcs that are still open
    free: list[int] = []

    def freeze(down_to: int) -> None:
        while len(path) > down_to:
            state, byte = path.pop()
            child = arcs[state][byte]
            same = known.setdefault((final[child], *sorted(arcs[child].items())), child)
            if same != child:
                arcs[state][byte] = same
                arcs[child], final[child] = {}, False
                free.append(child)

    last = b""
    for i in order:
        word, common = words[i], 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        freeze(common)
        state = arcs[path[-1][0]][path[-1][1]] if path else 1
        for byte in word[common:]:
            if free:
                child = free.pop()
            else:
                child = len(arcs)
                arcs.append({})
                final.append(False)
            arcs[state][byte] = child
            path.append((state, byte))
            state = child
        final[state] = True
        last = word
    freeze(0)
    used = sorted({b for w in words for b in w})
    classes = np.zeros(256, np.int16)
    classes[used] = 1 + np.arange(len(used))
    shape = (len(arcs), len(used) + 1)
    nexts, before, below = np.zeros(shape, np.int32), np.zeros(shape, np.int32), [-1] * len(arcs)
    below[0] = 0
    stack = [1]
    while stack:  # words below each state, children first
        state = stack[-1]
        todo = [c for c in arcs[state].values() if below[c] < 0]
        if todo:
            stack.extend(todo)
            continue
        stack.pop()
        total = int(final[state])
        for byte, child in sorted(arcs[state].items()):
            nexts[state, classes[byte]], before[state, classes[byte]] = child, total
            total += below[child]
        below[state] = total
    lengths = np.array([len(ids[i]) for i in order], np.int32)
    flat = np.fromiter((x for i in order for x in ids[i]), np.int32, int(lengths.sum()))
    return dict(classes=classes, next=nexts, before=before, ends=np.array(final), starts=(np.cumsum(lengths) - lengths).astype(np.int32), lengths=lengths, flat=flat)


def mapped(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The arrays mapped into memory from a nameless file of this worker, so that they count as page cache and not as its own memory."""
    with tempfile.TemporaryFile() as f:
        at = []
        for x in arrays.values():
            at.append(f.tell())
            f.write(np.ascontiguousarray(x).tobytes() + b"\0" * (-x.nbytes % 16))
        f.flush()
        return {k: np.memmap(f, x.dtype, "r", place, x.shape) if x.size else x for (k, x), place in zip(arrays.items(), at)}


def look_up(lexicon: dict[str, np.ndarray], words: pa.Array) -> np.ndarray:
    """The number of each word in the automaton, -1 if it is not accepted."""
    raw_at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] else np.empty(0, np.uint8)
    lengths = np.diff(raw_at)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] <= LONGEST]
    state, number = np.ones(len(order), np.int32), np.zeros(len(order), np.int64)
    starts, sizes = raw_at[:-1][order], lengths[order]
    for step in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(-sizes, -step, "left"))  # words longer than step stand first
        cls = lexicon["classes"][raw[starts[:n] + step]]
        number[:n] += lexicon["before"][state[:n], cls]
        state[:n] = lexicon["next"][state[:n], cls]
    out = np.full(len(words), -1, np.int64)
    out[order] = np.where(lexicon["ends"][state], number, -1)
    return out


@functools.lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


class Encoder(ChunkEncoder):
    """Encodes batches of texts with a compiled lexicon."""

    def __init__(self, path: str, lexicon: dict[str, np.ndarray]):
        super().__init__(cut_before_spaces)
        self.merges, self.lexicon = merges(path), mapped(lexicon)

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        return self.merges.merge([x.encode() for x in parts])

    def encode_whole(self, chunks: list[str]) -> list[list[int]]:
        return self.merges.encode(chunks)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the n+1 places in it where texts begin and end."""
        lists = self.cut(texts)
        coded = lists.flatten().dictionary_encode()
        lexicon = self.lexicon
        number = look_up(lexicon, coded.dictionary)
        rest = np.flatnonzero(number < 0)
        ids, own = self.chunks.ids(coded.dictionary.take(pa.array(rest)))
        starts, lengths = lexicon["starts"][number].astype(np.int64), lexicon["lengths"][number].astype(np.int64)
        starts[rest], lengths[rest] = len(lexicon["flat"]) + np.cumsum(own) - own, own
        flat = np.concatenate([lexicon["flat"].astype(np.uint32), ids])
        codes = coded.indices.to_numpy()
        lengths = lengths[codes]
        return flat[expand(starts[codes], lengths)], text_bounds(lists, lengths)


#: The encoder of the query that this worker last worked for.
_encoders: dict[str, Encoder] = {}


def _counted(batches):
    for batch in batches:
        for first, rows in slices(batch.column("text"), 4 << 20):
            counts = pc.value_counts(cut_before_spaces(filled(batch.column("text").slice(first, rows))).flatten())
            yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=["word", "n"])


def frequent_words(docs: DataFrame, most: int = LEXICON) -> list[str]:
    """The most frequent words of all texts, at most so many, in order. Counts are told apart to a 64th of a doubling; of words alike in that, those with the smallest hash come first."""
    counts = docs.select("text").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = counts.where((F.length("word") > 0) & (F.octet_length("word") <= LONGEST))
    rarity = F.shiftleft(F.lit(1 << 12) - F.floor(F.log2("n") * 64), 40) + F.xxhash64("word").bitwiseAND(F.lit((1 << 40) - 1))
    counts = saved(counts.select("word", rarity.alias("rarity")), "word-counts")
    words = sorted(x.word for x in smallest_keys(counts, F.col("rarity"), most).select("word").collect())
    dropped(counts)
    return words


def compiled(docs: DataFrame, path: str) -> dict[str, np.ndarray]:
    words = frequent_words(docs)
    return compile_words([x.encode() for x in words], merges(path).encode(words))


def _digested(path: str, shared):
    number = uuid.uuid4().hex

    def digest(batches):
        encoder = _encoders.get(number)
        if encoder is None:
            _encoders.clear()
            encoder = _encoders[number] = Encoder(path, shared.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for first, rows in slices(batch.column("text"), 4 << 20):
                ids, at = encoder.encode(filled(batch.column("text").slice(first, rows)))
                raw = ids.astype("<u4")
                decoded = encoder.merges.decode(ids, at)
                columns = [batch.column("doc_id").slice(first, rows), pa.array(np.diff(at)), pa.array([sha(raw[a:b]) for a, b in zip(at[:-1], at[1:])], pa.string()), pa.array([sha(x) for x in decoded], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def bpe_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    lexicon = docs.sparkSession.sparkContext.broadcast(compiled(docs, path))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digested(path, lexicon), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
