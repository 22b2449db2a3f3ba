"""Quality classifier: a linear support vector machine over n-gram indicators scaled by naive Bayes log-count ratios.

Indicators are hashed byte trigrams and runs of the text's novelty: whether each pair of words has come before in it. Their log-count ratios and the
hinge-loss weights, by dual coordinate descent, come from a bounded sample of labelled rows (SAMPLE_ROWS, a parameter); a fifth of it
is held back and turns margins into probabilities. The model, some hundred kB, goes to all tasks, which score whole texts where the rows are.

Defined results: null text counts as empty; an empty text has a score (that of no indicator); rows with a null label or doc_id teach nothing; of
several labels of a document the largest counts, and of several rows of a doc_id the smallest text teaches; repeated rows are scored each; with no labels, or of one class alone, every score is the share of label 1 (0.5 without labels);
an empty table gives an empty result; other columns are ignored by quality_scores and kept by drop_low_quality.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import filled, saved, slices, smallest_keys, text_of

#: Labelled rows that a classifier is fitted on, at most, and bytes of a text that may teach: 786 MB of text in all, and far less as features.
SAMPLE_ROWS, SAMPLE_TEXT = 12_000, 1 << 16
THRESHOLD = 0.3
#: The score's name beside columns of any name.
SCORE = "__depthlake_score"
TRIGRAMS, RUN = 1 << 16, 8
FEATURES = TRIGRAMS + (1 << RUN)
#: Texts whose indicators are set at once: a table of a few MB.
GROUP = 64


def novelty(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For every run of RUN pairs of words: the text, and the pattern of pairs that came before in the text."""
    lists = pc.ascii_split_whitespace(texts)
    codes = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    counts = lists.value_lengths().to_numpy()
    rows = np.repeat(np.arange(len(texts)), counts)
    same = rows[1:] == rows[:-1]
    pairs = (codes[:-1] * (int(codes.max(initial=0)) + 1) + codes[1:])[same]
    rows = rows[1:][same]
    order = np.lexsort((pairs, rows))  # stable: the first of equal pairs comes first
    seen = np.zeros(len(pairs), np.int64)
    seen[order[1:]] = (pairs[order[1:]] == pairs[order[:-1]]) & (rows[order[1:]] == rows[order[:-1]])
    if len(pairs) < RUN:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    patterns = sum(seen[i : len(seen) - RUN + 1 + i] << i for i in range(RUN))
    whole = rows[RUN - 1 :] == rows[: len(rows) - RUN + 1]
    return rows[RUN - 1 :][whole], patterns[whole]


def indicators(texts: pa.Array):
    """(row, feature) pairs of the texts, without repeats, in blocks ordered by row: yields (rows, features)."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    raw = np.frombuffer(b"".join(x.encode() for x in texts.to_pylist()), np.uint8)
    run_rows, patterns = novelty(texts)
    for first in range(0, len(texts), GROUP):
        last = min(first + GROUP, len(texts))
        a, b = (ends[first - 1] if first else 0), ends[last - 1]
        flags = np.zeros((last - first, FEATURES), bool)
        own = raw[a:b].astype(np.uint32)
        if len(own) > 2:
            grams = (own[:-2] << np.uint32(16)) | (own[1:-1] << np.uint32(8)) | own[2:]
            rows = np.repeat(np.arange(last - first), np.diff(np.concatenate([[a], ends[first:last]])))
            inside = rows[2:] == rows[:-2]
            flags[rows[2:][inside], ((grams[inside] * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)] = True
        lo, hi = np.searchsorted(run_rows, [first, last])
        flags[run_rows[lo:hi] - first, TRIGRAMS + patterns[lo:hi]] = True
        rows, features = np.nonzero(flags)
        yield rows + first, features


def _features(batches):
    for batch in batches:
        for first, rows in slices(batch.column("text")):
            run = batch.slice(first, rows)
            found = list(indicators(filled(run.column("text"))))
            at = np.searchsorted(np.concatenate([x for x, _ in found]), np.arange(rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([x for _, x in found]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([run.column("label"), lists], names=["label", "features"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, *columns: Column) -> DataFrame:
    """text, label and columns of at most so many rows, one for a doc_id (that with the smallest text): those with the smallest hash of doc_id.

    learn: which rows of labels may teach. Texts of more than SAMPLE_TEXT bytes teach nothing.
    """
    fits = ~F.coalesce(F.octet_length("text") > SAMPLE_TEXT, F.lit(False))
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    # labels of documents that aren't there, or are too long, take no place in the sample
    there = docs.where(fits).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    known = saved(known.join(there, "doc_id", "left_semi"), "labelled")
    chosen = smallest_keys(known, F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 63) - 1)), rows)
    own = docs.where(fits).select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(text_of().alias("text"), *columns).alias("row"))
    return own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("row").alias("row"), F.first("label").alias("label")).select("label", "row.*")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def calibrate(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins, each counted so many times, by Newton's method with smoothed targets."""
    weights = np.ones(len(labels)) if weights is None else weights
    n1, n0 = (weights * labels).sum(), (weights * (1 - labels)).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, theta = np.stack([margins, np.ones(len(margins))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ theta)
        h = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weights * (p - target)))
        theta = theta - np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return float(theta[0]), float(theta[1])


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, cost: float = 1.0, rounds: int = 8) -> np.ndarray:
    """Weights that minimise |w|^2 / 2 + cost * sum(max(0, 1 - y w.x)); the last feature is the bias. Each row has norm sqrt(2) at most."""
    w, alpha = np.zeros(FEATURES + 1), np.zeros(len(rows))
    norms = np.array([x @ x for x in values])
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = signs[i] * (w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost)
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * signs[i] * values[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def fit(features: list[np.ndarray], labels: np.ndarray) -> dict:
    """The model: scale (log-count ratios), weights over scaled indicators, slope and offset."""
    share = float(labels.mean()) if len(labels) else 0.5
    held = np.arange(len(labels)) % 5 == 4
    flat = dict(scale=np.zeros(FEATURES), weights=np.zeros(FEATURES), bias=0.0, slope=0.0, offset=float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    if len(set(labels[~held])) < 2 or len(set(labels[held])) < 2:
        return flat
    counts = np.ones((2, FEATURES))
    for i in np.flatnonzero(~held):
        counts[labels[i], features[i]] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    scale = np.log(counts[1] / counts[0])
    rows, values = [], []
    for f in features:
        x = scale[f]
        rows.append(np.append(f, FEATURES))
        values.append(np.append(x / max(np.sqrt(x @ x), 1e-9), 1.0))
    at = np.flatnonzero(~held)
    w = dual_coordinate_descent([rows[i] for i in at], [values[i] for i in at], np.where(labels[at] == 1, 1.0, -1.0))
    margins = np.array([w[rows[i]] @ values[i] for i in np.flatnonzero(held)])
    slope, offset = calibrate(margins, labels[held])
    return dict(scale=scale, weights=w[:-1], bias=float(w[-1]), slope=slope, offset=offset)


def train(sample: DataFrame) -> dict:
    """A model from a bounded table (text, label)."""
    table = sample.mapInArrow(_features, "label int, features array<int>").toArrow()
    labels = table.column("label").to_numpy().astype(np.int64)
    lists = table.column("features").combine_chunks()
    values, at = (lists.values.to_numpy(), lists.offsets.to_numpy()) if len(labels) else (np.empty(0, np.int32), np.zeros(1, np.int64))
    features = [values[a:b] for a, b in zip(at[:-1], at[1:])]
    order = sorted(range(len(labels)), key=lambda i: (len(features[i]), int(features[i].sum()), labels[i]))  # whatever the order of tasks
    return fit([features[i] for i in order], labels[order])


def score_texts(texts: pa.Array, model: dict) -> np.ndarray:
    """Probability of label 1 for each text."""
    dots, norms = np.zeros(len(texts)), np.zeros(len(texts))
    for rows, features in indicators(texts):
        x = model["scale"][features]
        dots += np.bincount(rows, x * model["weights"][features], len(texts))
        norms += np.bincount(rows, x * x, len(texts))
    return sigmoid(model["slope"] * (dots / np.maximum(np.sqrt(norms), 1e-9) + model["bias"]) + model["offset"])


def _scored(shared, name: str = "score"):
    def score(batches):
        model = shared.value
        for batch in batches:
            scores = [score_texts(filled(batch.column("text").slice(first, rows)), model) for first, rows in slices(batch.column("text"))]
            yield batch.append_column(name, pa.array(np.concatenate(scores) if scores else np.empty(0)))

    return score


def fitted(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = SAMPLE_ROWS):
    return docs.sparkSession.sparkContext.broadcast(train(labelled_sample(docs, labels, label, learn, rows)))


def fold(modulus: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fitted(docs, labels, "quality", fold(5) != 0)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(model), "doc_id long, text string, score double")
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their columns."""
    model = fitted(docs, labels, "quality", fold(5) != 0)
    scored = docs.mapInArrow(_scored(model, SCORE), StructType([*docs.schema.fields, StructField(SCORE, DoubleType())]))
    return scored.where(F.col(SCORE) >= THRESHOLD).select(*docs.columns)
