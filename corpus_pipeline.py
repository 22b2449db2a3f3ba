"""A corpus pipeline over documents: five stages, each an operator of depthlake.llm on what the one before it kept.

Defined results, in every stage: a null text counts as empty; a null in another column changes nothing; rows with a null doc_id are judged by the quality stage as all others, and stay in
the near-copy stage; of rows that repeat, or share a text, one stays; a text of any length is taken whole; other columns, of any name, are kept by all stages but the last; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from depthlake.llm.exact_dedup import drop_exact_copies
from depthlake.llm.near_copies import drop_near_copies
from depthlake.llm.packing import packed_pieces
from depthlake.llm.quality import drop_low_quality
from depthlake.llm.queries import BYTE_VOCABULARY, read_labels
from depthlake.llm.secret_scan import mask_secrets
from depthlake.llm.shared import read_documents, saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts."""
    return drop_low_quality(docs, read_labels(spark, sf_dir))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest doc_id."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard of five-word shingles 0.8 or more): that with the smallest doc_id."""
    return drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the code points of secrets masked."""
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packed_pieces(docs, BYTE_VOCABULARY)


STAGES = [("quality", quality), ("exact copies", exact_copies), ("near copies", near_copies), ("secrets", secrets), ("packing", packing)]

#: SQL can't express the classifier, the near copies and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; what each keeps is a written table."""
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
