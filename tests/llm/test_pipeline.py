"""The pipeline's stages, one after the other."""

import random

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from depthlake.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        new = stage(spark, docs, DATA)
        assert new.columns == columns
        new = spark.createDataFrame(new.collect(), docs.schema)
        assert 0 < new.count() <= kept and new.join(docs, "doc_id", "left_anti").count() == 0
        docs, kept = new, new.count()
    # how documents are cut depends on what a task holds; their ids don't
    ids = lambda pieces: {r.doc_id: r.n for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    pieces = ids(pipeline.STAGES[-1][1](spark, docs, DATA))
    assert len(pieces) == kept and ids(pipeline.run(spark, DATA)) == pieces
    assert len(QUERIES) == 13


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, node string, row int, label string, place string, copy double"


def written(spark, folder, rows):
    """A folder of tables with these documents, of columns that clash with the stages' own, and labels of the smallest tables."""
    spark.createDataFrame([(d, t, lang, None, None, "s", None, 1, "x", None, 0.5) for d, t, lang in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    (labels if rows else labels.limit(0)).write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_awkward_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and ties, through every stage and through run()."""
    rng = random.Random(1)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200_000))
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows += [(None, None, None), (None, "", "en"), (None, "no one's text of a few words", None), (1000, long, "en"), (1001, long + " end", "en"), (1002, " \n", None), (1003, "password = hunter2hunter2", "en"), *rows[:20], *[(5000, "the same row many times over", "en")] * 60]
    docs = written(spark, f"{tmp_path}/sf", rows)
    columns, before = docs.columns, docs
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, before, f"{tmp_path}/sf").write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        assert after.columns == columns and after.dtypes == docs.dtypes
        texts = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.collect())
        old, new = texts(before), texts(after)
        if name == "quality":
            assert set(new) <= set(old)
        if name == "exact copies":
            assert len({t for _, t in new}) == len(new) and {t for _, t in new} == {t for _, t in old}
        if name == "near copies":
            assert set(new) <= set(old) and sum(t.startswith(long) for _, t in new) == (any(t.startswith(long) for _, t in old))
        if name == "secrets":
            assert [(d, len(t)) for d, t in new] == [(d, len(t)) for d, t in old] and not any("hunter2" in t for _, t in new)
        before = after
    pieces = pipeline.STAGES[-1][1](spark, before, f"{tmp_path}/sf").collect()
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)
    # a document's pieces, whoever shares its doc_id, hold each of its ids once
    tokens = {}
    for r in pieces:
        tokens.setdefault(str(r.doc_id), []).append((r.start, r.length, r.doc_tokens))
    kept = before.groupBy("doc_id").count().collect()
    assert {str(r.doc_id) for r in kept} == set(tokens)
    for r in kept:
        own = tokens[str(r.doc_id)]
        if r["count"] == 1:
            assert sum(n for _, n, _ in own) == own[0][2] and sorted(s for s, _, _ in own)[0] == 0
    again = pipeline.run(spark, f"{tmp_path}/sf")
    assert sum(r.length for r in again.collect()) == sum(r.length for r in pieces)


def test_empty_tables(spark, tmp_path):
    docs = written(spark, f"{tmp_path}/sf", [])
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, f"{tmp_path}/sf").collect() == []
    assert pipeline.run(spark, f"{tmp_path}/sf").collect() == []
