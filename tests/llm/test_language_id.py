"""Language identification: subwords and scores by plain code, held-out accuracy, awkward rows."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from depthlake.llm import language_id as lid

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score string, names int"


def plain_subwords(text):
    """Buckets of one text, by loops."""
    raw, last = bytearray(), None
    for c in text.lower():
        edge = ord(c) < 128 and not "a" <= c <= "z"
        if not (edge and last):
            raw += b" " if edge else c.encode()
        last = edge
    raw = raw if raw.startswith(b" ") else b" " + raw
    raw = raw if raw.endswith(b" ") else raw + b" "
    out = []
    for k in (3, 4, 5):
        for i in range(len(raw) - k + 1):
            own = raw[i : i + k]
            if 32 not in own[1:-1]:
                key = int.from_bytes(own, "big")
                out.append(((key * 8 + k - 1) * int(lid.FACTOR) % (1 << 64)) >> (64 - lid.BITS))
    return sorted(out)


TEXTS = ["", " ", "a", "The cat, the dog.", "ÀÉ né à l'été", "日本語 です", "x" * 40, "a1b2", "  two  spaces\n\tend ", "ß😀"]


def test_subwords():
    row, bucket = lid.subwords(pa.array(TEXTS))
    for i, text in enumerate(TEXTS):
        # an edge that is there already and one that is added make two spaces, between which no subword is
        assert sorted(bucket[row == i].tolist()) == plain_subwords(text), text


def test_scores():
    rng = np.random.default_rng(1)
    model = dict(names=["a", "b", "c"], scores=rng.normal(size=(lid.BUCKETS, 3)).astype(np.float32), least=0.5)
    own, score = lid.predict_texts(pa.array(TEXTS), model)
    for i, text in enumerate(TEXTS):
        buckets = plain_subwords(text)
        mean = [sum(float(model["scores"][b, k]) for b in buckets) / max(1, len(buckets)) for k in range(3)]
        p = np.exp(mean) / np.exp(mean).sum()
        assert own[i] == int(np.argmax(p)) and abs(score[i] - p.max()) < 1e-9


def test_descent_follows_the_gradient():
    """One step on one text is the rate times the derivative of the cross-entropy, by differences."""
    buckets, shares = [np.array([3, 9])], [np.array([0.25, 0.75], np.float32)]
    loss = lambda t, w: -np.log(lid.softmax((shares[0] @ t[buckets[0]]) @ w)[1])
    start, layer = lid.descend(buckets, shares, np.array([1]), 3, rounds=0)
    layer = layer + np.random.default_rng(2).normal(size=layer.shape) * 0.1
    hidden = shares[0] @ start[buckets[0]]
    error = lid.softmax(hidden @ layer) - np.eye(3)[1]
    for i in range(lid.WIDTH):
        moved = layer.copy()
        moved[i, 2] += 1e-3
        assert abs((loss(start, moved) - loss(start, layer)) / 1e-3 - hidden[i] * error[2]) < 1e-3
        table = start.astype(float)
        table[9, i] += 1e-3
        assert abs((loss(table, layer) - loss(start, layer)) / 1e-3 - 0.75 * (layer @ error)[i]) < 1e-3
    table, layer = lid.descend(buckets * 2, shares * 2, np.array([1, 1]), 3)
    assert np.argmax((shares[0] @ table[buckets[0]]) @ layer) == 1 and not table[0].any()


def test_rejection():
    scores, right = np.array([0.9, 0.8, 0.8, 0.7, 0.6]), np.array([True, True, False, True, True])
    assert lid.rejection(scores, right, 0.75) == 0.6 and lid.rejection(scores, right, 0.9) == 0.9
    assert lid.rejection(scores, np.zeros(5, bool)) > 1 and lid.rejection(np.empty(0), np.empty(0, bool)) > 1
    logits = np.array([[2.0, 0.0]] * 10)
    assert lid.temperature(logits, np.array([0] * 6 + [1] * 4)) < 1 < lid.temperature(logits / 20, np.array([0] * 10))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = lid.language_scores(docs)
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.99 and np.mean([r.rejected for r in held]) < 0.05
    assert all(0 <= r.score <= 1 for r in rows)


def test_learns_from_its_fold_alone(spark):
    """Other languages, and texts, in the held-out fold change nothing that is predicted for the rest."""
    words = {"xx": "alba nona rilo", "yy": "gruk strup mokt"}
    rows = [(i, " ".join([words[lang]] * (1 + i % 4)), lang, None, 0) for i in range(200) for lang in [["xx", "yy"][i % 2]]]
    docs = spark.createDataFrame(rows, SCHEMA)
    other = docs.withColumn("lang", F.when(lid.fold(3) == 1, "zz").otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, lid.language_scores(x).collect())) for x in (docs, other))
    assert a == b and {r[2] for r in a} == {"xx", "yy"} and all(r[2] == rows[r[0]][2] for r in a)


def test_awkward_rows(spark):
    rows = [(i, f"{w} {w} {w}", lang, "s", 1) for i in range(60) for lang, w in [[("aa", "nolima"), ("bb", "krutz")][i % 2]]]
    hot = [(6, "nolima nolima", "aa", "s", 1)] * 300
    odd = [(100, None, "aa", None, 1), (101, "", "bb", None, 1), (102, "123 !? \n", "aa", None, 1), (None, "nolima", "aa", None, 1), (None, None, None, None, None), (103, "nolima", None, None, 1), (104, "krutz " * 60_000, "bb", None, 1), (105, "日本語", "aa", None, 1)]
    docs = spark.createDataFrame(rows + hot + odd, SCHEMA).repartition(4)
    found = lid.languages(docs).collect()
    assert len(found) == len(rows + hot + odd)
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and [by[i].score for i in (100, 101, 102)] == [0.0] * 3 and by[101].rejected
    assert (by[6].lang_pred, by[103].lang_pred, by[104].lang_pred) == ("aa", "aa", "bb")
    taught = lid.teaching_rows(docs, F.lit(True), rows=10)
    assert taught.count() <= 40 and taught.groupBy("lang", "key").count().where("count > 1").count() == 0
    assert lid.language_scores(spark.createDataFrame([], SCHEMA)).collect() == []
    untaught = lid.languages(spark.createDataFrame([(1, "words", None, "", 1), (2, None, None, "", 1)], SCHEMA)).collect()
    assert [(r.lang_pred, r.score, r.rejected) for r in untaught] == [("und", 0.0, True)] * 2
