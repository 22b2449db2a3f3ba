"""The Merkle manifest against a plain tree."""

import hashlib
import os
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from depthlake.llm import merkle
from depthlake.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, node string, tree int, path string, root double"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {k: sorted(groups[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for k in names}
    trees = {k: levels([leaf(r) for r in ordered[k]]) for k in names}
    top, out = levels([trees[k][-1][0] for k in names]), []
    for t, k in enumerate(names):
        for i, r in enumerate(ordered[k]):
            path = []
            for tree, at in ((trees[k], i), (top, t)):
                for level in tree[:-1]:
                    path.append((at % 2, level[at ^ 1] if at ^ 1 < len(level) else ""))
                    at //= 2
            own = again = leaf(r)
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                again = leaf((*r[:3], r[3] + 1, r[4]))
            for left, other in path:
                again = digest(other + again if left else again + other)
            out.append((r[0], own, trees[k][-1][0], top[-1][0], digest("".join(x for _, x in path)), again, again == top[-1][0]))
    return sorted(map(str, out))


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, None, 0.5) for r in rows], SCHEMA).repartition(3)


def awkward():
    rows = [(i, f"s{i % 3}", "en", 10 + i, "t" * (i % 50)) for i in range(700)]  # more than two blocks, and a last one that is not full
    rows += [(i, "hot", "de", i, "gleich") for i in range(257)]  # one row over a block
    rows += [(i, None, None, None, None) for i in range(5)] + [(None, "s", None, 3, ""), (None, "s", "fr", 1 << 62, "é日😀")]
    rows += [(7, "s", "en", 3, "tie"), (7, "s", "en", 3, "tie"), (7, "s", "en", 4, "tie"), (9, "", "", 0, ""), (1, "a", "-", 1, "x" * 100_000)]
    return rows


@pytest.mark.parametrize("rows", [awkward(), awkward()[:1], awkward()[:256], awkward()[:257], awkward()[700:702]], ids=len)
def test_manifest(spark, rows):
    found = merkle.manifest_digest(table(spark, rows)).collect()
    assert sorted(str(tuple(r)) for r in found) == plain(rows)


def test_blocks_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DEEP", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    rows = [r for r in awkward() if r[0] != 1]
    assert sorted(str(tuple(r)) for r in merkle.manifest_digest(table(spark, rows)).collect()) == plain(rows)


def test_files_of_few_rows(spark):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 50)
    try:
        assert sorted(str(tuple(r)) for r in merkle.manifest_digest(table(spark, awkward())).collect()) == plain(awkward())
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_empty_table(spark):
    assert merkle.manifest_digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_written_manifest(spark, tmp_path):
    docs = table(spark, [r for r in awkward() if r[0] is not None and r[2] == "en" and r[4] != "tie"])
    merkle.write_manifest(docs, f"{tmp_path}/m")
    known = spark.read.parquet(f"{tmp_path}/m")
    assert {r.verified for r in merkle.verified(docs, known).collect()} == {True}
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 100 == 3, "other").otherwise(F.col("text"))).unionByName(docs.limit(1).withColumn("doc_id", F.lit(10_000).cast("long")))
    assert sorted(r.doc_id for r in merkle.verified(changed, known).collect() if not r.verified) == [*range(3, 700, 100), 10_000]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["op11_merkle", "op13_fill_in_middle"])
def test_sql(spark, name):
    found = QUERIES[name](spark, DATA)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
        known = db.sql(ORACLE_SQL[name]).arrow().read_all()
    columns = sorted(known.column_names)
    assert sorted(found.columns) == columns
    assert sorted(map(str, found.select(*columns).toArrow().to_pylist())) == sorted(map(str, known.select(columns).to_pylist()))
