"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are its runs of three, four and five bytes inside words and at their edges, in lower case; each is hashed to a row of an embedding table. The mean of a text's rows goes
through a linear layer and a softmax. Both are trained by stochastic gradient descent in numpy, on a bounded sample of rows with a language (LEARN_ROWS for each of at most MOST_LANGUAGES, and
LEARN_TEXT, parameters); a fifth of it is held back, sets the temperature of the softmax and, from that, the score below which a prediction is rejected. Since the mean and the
layer are linear, a model is applied as one table of scores for each subword and language: a few MB, which go to all tasks. Texts are scored whole, where the rows are.

Defined results: a text that is null or has no letter is `und` with score 0 and rejected; a text without known subwords has the first language and the lowest score; rows without a language, a doc_id or a letter teach nothing; if nothing
teaches, every text is `und`, score 0; of the rows of one doc_id and language the smallest text teaches, and each is predicted; ties go to the language that comes first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import fold
from .shared import filled, slices

#: What may teach, at most: so many rows of a language (about; those with the smallest hashes), languages (the most frequent ones), and bytes of a text.
LEARN_ROWS, MOST_LANGUAGES, LEARN_TEXT = 1000, 64, 1 << 14
#: Rows of the embedding table (a power of two), its columns, and lengths of subwords in bytes.
BITS, WIDTH, SIZES = 15, 16, (3, 4, 5)
BUCKETS = 1 << BITS
ROUNDS, RATE, SEED = 5, 0.5, 0
#: The share of right answers that accepted predictions had at least on held-back rows.
RIGHT = 0.99
UNKNOWN = "und"
LETTER = r"\p{L}"
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all subwords of the texts, repeats included. White space, digits and ASCII marks are edges of words."""
    lowered = pc.utf8_lower(texts)
    spaced = pc.binary_join_element_wise("", pc.replace_substring_regex(lowered, r"[\x00-\x40\x5b-\x60\x7b-\x7f]+", " "), "", " ")
    sizes = pc.binary_length(spaced).to_numpy().astype(np.int64)
    raw = np.frombuffer(b"".join(x.as_buffer() for x in spaced), np.uint8)
    rows = np.repeat(np.arange(len(texts)), sizes)
    found_rows, found = [], []
    inside = raw != 32
    key = raw.astype(np.uint64)
    own = np.ones(len(raw), bool)
    for k in range(1, max(SIZES)):
        key = (key[:-1] << np.uint64(8)) | raw[k:]
        # a space may only be the first or the last byte of a subword
        own = own[:-1] & (inside[k - 1 : len(raw) - 1] if k > 1 else True)
        if k + 1 in SIZES:
            keep = own & (rows[k:] == rows[: len(rows) - k])
            found.append((((key[keep] * np.uint64(8) + np.uint64(k)) * FACTOR) >> np.uint64(64 - BITS)).astype(np.int32))
            found_rows.append(rows[: len(rows) - k][keep])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    return np.concatenate(found_rows), np.concatenate(found)


def _counted(batches):
    """Each text's subwords as sorted buckets and their shares of the text."""
    for batch in batches:
        for first, rows in slices(batch.column("text")):
            run = batch.slice(first, rows)
            row, bucket = subwords(filled(run.column("text")))
            pairs, counts = np.unique(row * BUCKETS + bucket, return_counts=True)
            row, bucket = pairs >> BITS, pairs & (BUCKETS - 1)
            shares = (counts / np.bincount(row, counts, rows)[row]).astype(np.float32)
            at = pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (bucket.astype(np.int32), shares)]
            yield pa.RecordBatch.from_arrays([run.column("lang"), run.column("key"), *lists], names=["lang", "key", "buckets", "shares"])


def teaching_rows(docs: DataFrame, learn: Column, rows: int = LEARN_ROWS, languages: int = MOST_LANGUAGES) -> DataFrame:
    """(lang, key, text): about so many rows of each language, those with the smallest keys, a hash of doc_id, and of one doc_id the smallest text; of at most so many languages, the most frequent ones."""
    key = F.xxhash64(F.col("doc_id").cast("long")).bitwiseAND(F.lit((1 << 63) - 1))
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & learn & (F.octet_length("text") <= LEARN_TEXT) & F.col("text").rlike(LETTER))
    usable = usable.select(F.col("lang").cast("string").alias("lang"), key.alias("key"), "text")
    known = usable.select("lang", "key").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    # keys are spread evenly, so a language's share of them has about so many rows
    bounds = [(r.lang, min((1 << 63) - 1, int((1 << 63) * rows / r.n))) for r in known]
    taken = F.lit(False)
    for lang, bound in bounds:
        taken = taken | ((F.col("lang") == lang) & (F.col("key") <= bound))
    return usable.where(taken).groupBy("lang", "key").agg(F.min("text").alias("text"))


def softmax(logits: np.ndarray) -> np.ndarray:
    x = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def descend(buckets: list[np.ndarray], shares: list[np.ndarray], labels: np.ndarray, classes: int, rounds: int = ROUNDS, rate: float = RATE) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings (BUCKETS, WIDTH) and layer (WIDTH, classes) by stochastic gradient descent on the cross-entropy, a text at a time; the rate falls to zero. Rows of subwords that no text has are zero."""
    rng = np.random.default_rng(SEED)
    seen = np.unique(np.concatenate(buckets)) if buckets else np.empty(0, np.int64)
    table, layer = np.zeros((BUCKETS, WIDTH), np.float32), np.zeros((WIDTH, classes), np.float32)
    table[seen] = rng.uniform(-1 / WIDTH, 1 / WIDTH, (len(seen), WIDTH))
    done, total = 0, rounds * len(labels)
    for _ in range(rounds):
        for i in rng.permutation(len(labels)):
            own, share = table[buckets[i]], shares[i]
            hidden = share @ own
            error = softmax(hidden @ layer)
            error[labels[i]] -= 1
            step = rate * (1 - done / total)
            back = layer @ error
            layer -= step * np.outer(hidden, error)
            # shares are small: a subword moves as if it were one of the text's rows of weight WIDTH
            table[buckets[i]] -= step * WIDTH * share[:, None] * back
            done += 1
    return table, layer


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The factor on logits under which held-back rows are likeliest; each counts as if one more row of every language were held back, so that rows without an error don't give certainty."""
    n, k = len(labels), logits.shape[1]
    target = np.full((n, k), 1 / (n + k))
    target[np.arange(n), labels] = (n + 1) / (n + k)
    factors = [2.0 ** (x / 4) for x in range(-16, 17)]
    return min(factors, key=lambda f: float(-(target * np.log(np.maximum(softmax(f * logits), 1e-12))).sum()))


def rejection(scores: np.ndarray, right: np.ndarray, share: float = RIGHT) -> float:
    """The smallest score such that of the held-back rows from it up the share given was right; over 1 if there is none."""
    order = np.argsort(-scores, kind="stable")
    kept = np.cumsum(right[order]) >= share * np.arange(1, len(scores) + 1)
    ends = np.append(scores[order][1:] != scores[order][:-1], True) if len(scores) else np.empty(0, bool)
    good = np.flatnonzero(kept & ends)
    return float(scores[order][good[-1]]) if len(good) else 1.1


def fit(langs: list[str], buckets: list[np.ndarray], shares: list[np.ndarray]) -> dict:
    """The model: its languages, the scores of each subword for each, and the score of rejection."""
    names, labels = np.unique(np.array(langs, dtype=object).astype(str), return_inverse=True) if langs else (np.empty(0, str), np.empty(0, np.int64))
    held = np.arange(len(labels)) % 5 == 4
    own, back = np.flatnonzero(~held), np.flatnonzero(held)
    table, layer = descend([buckets[i] for i in own], [shares[i] for i in own], labels[own], max(1, len(names)))
    scores = table @ layer
    logits = np.array([shares[i] @ scores[buckets[i]] for i in back]).reshape(len(back), max(1, len(names)))
    scores *= temperature(logits, labels[back])
    p = softmax(np.array([shares[i] @ scores[buckets[i]] for i in back]).reshape(len(back), max(1, len(names))))
    least = rejection(p.max(axis=1), p.argmax(axis=1) == labels[back]) if len(back) else 0.0
    return dict(names=[str(x) for x in names], scores=scores.astype(np.float32), least=least)


def train(rows: DataFrame) -> dict:
    """A model from a bounded table (lang, key, text)."""
    table = rows.mapInArrow(_counted, "lang string, key long, buckets array<int>, shares array<float>").toArrow()
    langs, keys = table.column("lang").to_pylist(), table.column("key").to_pylist()
    buckets, shares = (_lists(table.column(c)) for c in ("buckets", "shares"))
    order = sorted(range(len(langs)), key=lambda i: (keys[i], langs[i], len(buckets[i]), buckets[i].tobytes()))  # whatever the order of tasks
    return fit([langs[i] for i in order], [buckets[i] for i in order], [shares[i] for i in order])


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for chunk in column.chunks:
        values, at = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(at[:-1], at[1:])]
    return out


def predict_texts(texts: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """The language's number and the calibrated score of each text."""
    row, bucket = subwords(texts)
    n = np.maximum(np.bincount(row, minlength=len(texts)), 1)
    logits = np.stack([np.bincount(row, model["scores"][:, k][bucket], len(texts)) / n for k in range(model["scores"].shape[1])], axis=1)
    p = softmax(logits)
    return p.argmax(axis=1), p.max(axis=1)


def languages(docs: DataFrame, learn: Column | None = None, rows: int = LEARN_ROWS) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row. learn: which rows may teach; all by default. score: the calibrated probability of lang_pred. rejected: whether it is too low to rely on."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(teaching_rows(docs, F.lit(True) if learn is None else learn, rows)))

    def predict(batches):
        model = shared.value
        for batch in batches:
            names, scores = [pa.array([], pa.string())], [np.empty(0)]
            for first, count in slices(batch.column("text")):
                texts = filled(batch.column("text").slice(first, count))
                own, score = predict_texts(texts, model) if model["names"] else (np.zeros(count, np.int64), np.zeros(count))
                told = pc.match_substring_regex(texts, LETTER).to_numpy(zero_copy_only=False) & bool(model["names"])
                names.append(pc.if_else(pa.array(told), pa.array(model["names"] or [UNKNOWN]).take(pa.array(own)), UNKNOWN))
                scores.append(np.where(told, score, 0.0))
            name, score = pa.concat_arrays(names), np.concatenate(scores)
            rejected = pa.array((score < model["least"]) | pc.equal(name, UNKNOWN).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), name, pa.array(score), rejected], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")


def language_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    found = languages(docs, fold(3) != 1)
    return found.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
