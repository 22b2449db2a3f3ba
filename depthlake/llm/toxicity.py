"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of hashed vectors of the word, its beginnings and its end. Filters of several widths run over the words of a
whole text, each keeps its maximum, and a logistic unit reads the maxima. A convolution is linear before its maximum, so a text is scored by
adding rows of per-word tables. The net learns from all labelled rows: every task goes on from a common start over its own rows, and of each weight the mean is taken over the tasks that moved it.
The start is trained on the driver on a bounded sample (SAMPLE_ROWS, a parameter), which comes there as word numbers. A fifth of all labelled rows is held back; their outputs, counted in steps of 1 / STEPS,
turn the net's output into probabilities and give a threshold per language. The score itself never sees the language: the thresholds only give the extra column toxic_for_lang.

Defined results: null text counts as empty and has a score (that of no word); rows with a null label or doc_id teach nothing; of several labels of a
document the largest counts, and of several rows of a doc_id the smallest text teaches; repeated rows are scored each; with no labels, or of one class alone, every score is the share of label 1 (0 without
labels); a language that the sample lacks has the general threshold; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import calibrate, fold, labelled_sample, sigmoid
from .shared import Remembered, filled, flattened, slices, text_of

#: Labelled rows that the net's start is trained on, at most.
SAMPLE_ROWS = 12_000
#: Steps in which outputs of held-back rows are counted, and the largest output told apart.
STEPS, FAR = 256, 64
THRESHOLD = 0.3
BUCKETS, WIDTH = 1 << 16, 12
WIDTHS, FILTERS = (1, 2, 3), 8
ROUNDS, BATCH, RATE = 6, 32, 0.08
#: Hashes of a word: itself, beginnings of 3 to 6 letters, its last 4 letters.
HASHES = 6


def hashes_of(chunk: str) -> list[int]:
    """Bucket numbers of a chunk's word: its letters in lower case, without marks around them."""
    word = chunk.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789")
    part = lambda kind, x: zlib.crc32(f"{kind}{x}".encode()) % BUCKETS
    return [part("w", word), *(part(n, word[:n]) for n in (3, 4, 5, 6)), part("e", word[-4:])]


_hashed = Remembered(lambda chunks: (np.arange(len(chunks)), *flattened(list(map(hashes_of, chunks)))))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket numbers of the distinct chunks, the chunk of each word, and the n+1 places where texts begin and end."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    words = _hashed.ids(coded.dictionary)[0].astype(np.int32).reshape(-1, HASHES)
    return words, coded.indices.to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])


def maxima(table: np.ndarray, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each text's largest filter outputs; table has the outputs of each distinct word for every place in a filter; 0 where no window fits."""
    out = np.zeros((len(at) - 1, len(WIDTHS) * FILTERS), np.float32)
    column = 0
    for k, width in enumerate(WIDTHS):
        rows = np.flatnonzero(np.diff(at) >= width)
        if len(rows):
            n = len(codes) - width + 1
            sums = table[codes[:n], column : column + FILTERS]
            for j in range(1, width):
                sums = sums + table[codes[j : n + j], column + j * FILTERS : column + (j + 1) * FILTERS]
            # windows that reach into the next text count for none
            starts, ends = at[rows], at[rows + 1] - width + 1
            bounds = np.stack([starts, np.minimum(ends, n)], 1).ravel()
            if bounds[-1] == n:
                bounds = bounds[:-1]
            out[rows, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(sums, bounds, axis=0)[::2]
        column += width * FILTERS
    return np.maximum(out, 0)


class Net:
    """The classifier's weights."""

    def __init__(self):
        rng = np.random.default_rng(7)
        self.embedding = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
        self.filters = rng.normal(0, 0.3, (WIDTH, sum(WIDTHS) * FILTERS)).astype(np.float32)
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out, self.offset = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), np.float32(-1)
        self.slope, self.shift, self.thresholds = 1.0, 0.0, {}
        self.sums = {k: np.full_like(getattr(self, k), 1e-4) for k in ("embedding", "filters", "bias", "out", "offset")}

    def table(self, words: np.ndarray) -> np.ndarray:
        """Filter outputs of distinct words; the bias goes to the first place of each filter."""
        total = self.embedding[words[:, 0]]
        for j in range(1, HASHES):
            total = total + self.embedding[words[:, j]]
        out = total @ self.filters
        column = 0
        for k, width in enumerate(WIDTHS):
            out[:, column : column + FILTERS] += self.bias[k * FILTERS : (k + 1) * FILTERS]
            column += width * FILTERS
        return out

    def logits(self, words: np.ndarray, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        return maxima(self.table(words), codes, at) @ self.out + self.offset

    def scores(self, texts: pa.Array) -> np.ndarray:
        return sigmoid(self.slope * self.logits(*tokens(texts)).astype(np.float64) + self.shift)


#: A text as the bucket numbers of its distinct words, and the number of each word.
Coded = tuple[np.ndarray, np.ndarray]


def joined(texts: list[Coded]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Several texts as tokens() gives them."""
    base = np.cumsum([0, *(len(words) for words, _ in texts)])
    codes = [own + base[i] for i, (_, own) in enumerate(texts)]
    return np.concatenate([words for words, _ in texts]), np.concatenate(codes), np.cumsum([0, *map(len, codes)])


def train(texts: list[Coded], labels: np.ndarray, net: Net | None = None, rounds: int = ROUNDS) -> Net:
    """Adagrad on batches of texts, from a net if there is one; only the winning windows have gradients."""
    net, rng = net or Net(), np.random.default_rng(11)
    sums = net.sums

    def move(name, gradient, at=None):
        value, total = getattr(net, name), sums[name]
        if at is None:
            sums[name] = total + gradient * gradient
            setattr(net, name, value - RATE * gradient / np.sqrt(sums[name]))
        else:
            total[at] += gradient * gradient
            value[at] -= RATE * gradient / np.sqrt(total[at])

    for _ in range(rounds):
        order = rng.permutation(len(texts))
        for first in range(0, len(order), BATCH):
            batch = order[first : first + BATCH]
            own, codes, at = joined([texts[i] for i in batch])
            lengths = np.diff(at)
            table = net.table(own)
            hidden, best, column = np.zeros((len(batch), len(net.out)), np.float32), np.full((len(batch), len(net.out)), -1), 0
            for k, width in enumerate(WIDTHS):
                n = len(codes) - width + 1
                if n > 0:
                    window = table[codes[:n], column : column + FILTERS]
                    for j in range(1, width):
                        window = window + table[codes[j : n + j], column + j * FILTERS : column + (j + 1) * FILTERS]
                    for b in range(len(batch)):
                        if lengths[b] >= width:
                            part = window[at[b] : at[b + 1] - width + 1]
                            top = part.argmax(axis=0)
                            hidden[b, k * FILTERS : (k + 1) * FILTERS] = part[top, np.arange(FILTERS)]
                            best[b, k * FILTERS : (k + 1) * FILTERS] = at[b] + top
                column += width * FILTERS
            active = hidden > 0
            hidden = np.where(active, hidden, 0)
            error = (sigmoid(hidden @ net.out + net.offset) - labels[batch]).astype(np.float32)
            inner = np.where(active & (best >= 0), error[:, None] * net.out, 0).astype(np.float32)
            # back to the words of the winning windows
            d_table, column = np.zeros_like(table), 0
            for k, width in enumerate(WIDTHS):
                b, f = np.nonzero(inner[:, k * FILTERS : (k + 1) * FILTERS])
                f = f + k * FILTERS
                for j in range(width):
                    np.add.at(d_table, (codes[best[b, f] + j], column + j * FILTERS + f - k * FILTERS), inner[b, f])
                column += width * FILTERS
            hit = np.flatnonzero(d_table.any(axis=1))
            total = net.embedding[own[hit]].sum(axis=1)
            d_embedding = d_table[hit] @ net.filters.T
            move("out", (hidden * error[:, None]).sum(axis=0) + 1e-4 * net.out)
            move("offset", error.sum())
            move("bias", inner.sum(axis=0))
            move("filters", total.T @ d_table[hit])
            buckets, inverse = np.unique(own[hit].ravel(), return_inverse=True)
            gradient = np.zeros((len(buckets), WIDTH), np.float32)
            np.add.at(gradient, inverse, np.repeat(d_embedding, HASHES, axis=0))
            move("embedding", gradient, buckets)
    return net


def best_threshold(scores: np.ndarray, ones: np.ndarray, counts: np.ndarray | None = None) -> float:
    """The score with the largest F1 of label 1; each score stands for so many rows, so many of them with label 1."""
    order = np.argsort(-scores)
    right = np.cumsum(ones[order])
    f1 = 2 * right / (np.cumsum(np.ones(len(order)) if counts is None else counts[order]) + ones.sum())
    return float(scores[order[int(np.argmax(f1))]])


def held_back() -> Column:
    """Which rows are held back from training."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(5)) == 4


def _coded(batches):
    """The texts as two strings of bytes: BUCKETS fits 16 bits, and so a distinct word takes 12 bytes."""
    for batch in batches:
        for i, text in enumerate(filled(batch.column("text"))):
            words, codes, _ = tokens(pa.array([text.as_py()]))
            own = [batch.column("label").slice(i, 1), batch.column("lang").slice(i, 1), pa.array([words.astype(np.uint16).tobytes()]), pa.array([codes.astype(np.int32).tobytes()])]
            yield pa.RecordBatch.from_arrays(own, names=["label", "lang", "words", "codes"])


def _started(docs: DataFrame, labels: DataFrame, rows: int) -> Net:
    """A net trained on a sample."""
    sample = labelled_sample(docs, labels, "toxic", (fold(4) != 2) & ~held_back(), rows, F.col("lang").cast("string").alias("lang"))
    sample = sample.mapInArrow(_coded, "label int, lang string, words binary, codes binary").toArrow()
    order = pc.sort_indices(sample, [("words", "ascending"), ("codes", "ascending"), ("label", "ascending")]).to_numpy()  # whatever the order of tasks
    sample = sample.take(pa.array(order[np.random.default_rng(3).permutation(len(order))]))
    texts = [(np.frombuffer(w, np.uint16).reshape(-1, HASHES), np.frombuffer(c, np.int32)) for w, c in zip(sample.column("words").to_pylist(), sample.column("codes").to_pylist())]
    return train(texts, sample.column("label").to_numpy().astype(np.int64))


def _weights(net: Net) -> np.ndarray:
    """All weights in rows of WIDTH: the embedding's, then all others."""
    rest = np.concatenate([net.filters.ravel(), net.bias, net.out, [net.offset]])
    return np.concatenate([net.embedding, np.pad(rest, (0, -len(rest) % WIDTH)).reshape(-1, WIDTH)]).astype(np.float32)


def _set(net: Net, weights: np.ndarray) -> None:
    rest = weights[BUCKETS:].ravel()
    filters, bias, out, offset = np.split(rest, np.cumsum([net.filters.size, net.bias.size, net.out.size]))
    net.embedding, net.filters, net.bias, net.out, net.offset = weights[:BUCKETS], filters.reshape(net.filters.shape), bias, out, offset[0]


def _went_on(shared):
    """The rows of weights that a task's rows have moved from the start."""

    def learn(batches):
        net = pickle.loads(pickle.dumps(shared.value))
        before = _weights(net)
        for batch in batches:
            texts, labels = filled(batch.column("text")), batch.column("label").to_numpy().astype(np.int64)
            for first, rows in slices(texts):
                coded = [tokens(texts.slice(i, 1))[:2] for i in range(first, first + rows)]
                net = train(coded, labels[first : first + rows], net, 1)
        after = _weights(net)
        moved = np.flatnonzero((after != before).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(moved), *(pa.array(x.astype(np.float64)) for x in after[moved].T)], names=["at", *(f"w{i}" for i in range(WIDTH))])

    return learn


def _outputs(shared):
    def judge(batches):
        for batch in batches:
            texts = filled(batch.column("text"))
            found = [shared.value.logits(*tokens(texts.slice(first, rows))) for first, rows in slices(texts)]
            step = np.floor(np.clip(np.concatenate([np.empty(0), *found]), -FAR, FAR) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(step), batch.column("label"), batch.column("lang")], names=["step", "label", "lang"])

    return judge


def trained(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Net:
    """The net after all labelled rows; rows: those that its start is trained on."""
    context = docs.sparkSession.sparkContext
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(4) != 2)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    there = known.join(own.select("doc_id").distinct(), "doc_id", "left_semi").groupBy(held_back().alias("held"), "label").count().collect()
    total = sum(r["count"] for r in there)
    if len(there) < 4:
        net, share = Net(), sum(r["count"] for r in there if r.label == 1) / max(total, 1)
        net.slope, net.shift = 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return net
    # one row for a doc_id: that with the smallest text
    every = own.join(known.hint("merge"), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("row"), F.first("label").alias("label")).select("doc_id", "label", "row.*")
    net = _started(docs, labels, rows)
    names = [f"w{i}" for i in range(WIDTH)]
    moved = every.where(~held_back()).sortWithinPartitions(F.xxhash64("doc_id")).select("text", "label").mapInArrow(_went_on(context.broadcast(net)), "at long, " + ", ".join(f"{x} double" for x in names))
    mean = moved.groupBy("at").agg(*(F.avg(x).alias(x) for x in names)).toArrow()
    weights = _weights(net)
    weights[mean.column("at").to_numpy()] = np.stack([mean.column(x).to_numpy() for x in names], 1)
    net.sums = {}
    _set(net, weights)
    judged = every.where(held_back()).select("text", "label", "lang").mapInArrow(_outputs(context.broadcast(net)), "step long, label int, lang string")
    counts = judged.groupBy("lang", "step").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).orderBy("lang", "step").toArrow()
    step, n, ones = (counts.column(x).to_numpy().astype(np.float64) for x in ("step", "n", "ones"))
    output, langs = step / STEPS, np.array(counts.column("lang").to_pylist())
    net.slope, net.shift = calibrate(np.tile(output, 2), np.repeat([1, 0], len(step)), np.concatenate([ones, n - ones]))
    scores = sigmoid(net.slope * output + net.shift)
    for lang in sorted(set(langs.tolist())):
        at = langs == lang
        if 5 <= ones[at].sum() < n[at].sum():
            net.thresholds[lang] = best_threshold(scores[at], ones[at], n[at])
    return net


def _scored(shared):
    def score(batches):
        net = shared.value
        for batch in batches:
            texts = batch.column("text")
            found = [net.scores(filled(texts.slice(first, rows))) for first, rows in slices(texts, 8 << 20)]
            limits = [net.thresholds.get(x or "", THRESHOLD) for x in batch.column("lang").cast(pa.string()).to_pylist()]
            scores = np.concatenate(found) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array(scores >= np.array(limits))], names=["doc_id", "score", "toxic_for_lang"])

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, toxic_for_lang."""
    net = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInArrow(_scored(net), "doc_id long, score double, toxic_for_lang boolean")
    return scored.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "toxic_for_lang")
