"""Removal of repeated passages against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from depthlake.llm import suffix_dedup as S


def expected(rows):
    """rows: (doc_id, text), in order of doc."""
    seen, out = set(), []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - S.LENGTH + 1):
            window = raw[i : i + S.LENGTH]
            if window in seen:
                gone[i : i + S.LENGTH] = b"\1" * S.LENGTH
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(120), prose(40)
    texts = [None, "", "short", base, base, base[:99], base[:100], base[:101], "x" * 700, "xy" * 200, "x" * 300, prose(5) + passage + prose(9), passage, prose(3) + passage + passage + prose(3), base + base, prose(900)]
    for _ in range(25):  # near copies
        words = base.split()
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    return [(i * 3 - 10, t) for i, t in enumerate(texts)]


def removed(rows, buckets):
    """The steps in this process, as workers import the module anew: buckets of a given number, so that equals lie across their boundaries."""
    batch = lambda rows, schema: pa.RecordBatch.from_pylist(rows, schema)
    docs = pa.schema([("doc", pa.int64()), ("text", pa.string())])
    anchors = [r for b in S._anchors([batch([{"doc": d, "text": t or ""} for d, t in rows], docs)]) for r in b.to_pylist()]
    ranges = [(r["doc"], r["low"], r["high"]) for r in anchors if r["gram"] is None]
    by_gram = sorted((r for r in anchors if r["gram"] is not None), key=lambda r: (r["gram"], r["doc"], r["place"]))
    longs = pa.schema([(c, pa.int64()) for c in ("gram", "doc", "place", "low", "high")])
    open_ = {}
    for i in range(buckets):
        for b in S._shared_grams([batch(by_gram[len(by_gram) * i // buckets : len(by_gram) * (i + 1) // buckets], longs)]):
            for r in b.to_pylist():
                open_.setdefault(r["doc"], []).append(r)
    place = pa.struct([(c, pa.int64()) for c in ("place", "low", "high")])
    texts = [{"doc": d, "text": t or "", "open": [{k: x[k] for k in ("place", "low", "high")} for x in open_[d]]} for d, t in rows if d in open_]
    suffixes = [r for b in S._suffixes([batch(texts, docs.append(pa.field("open", pa.list_(place))))]) for r in b.to_pylist()]
    binary = [(c, pa.binary()) for c in ("after", "before")]
    schema = pa.schema([(c, pa.int64()) for c in ("doc", "place", "low", "high")] + binary)
    windows = []
    for by_before in (False, True):
        sides = ("before", "after") if by_before else ("after", "before")
        suffixes.sort(key=lambda r: (r[sides[0]], r[sides[1]], r["doc"], r["place"]))
        parts = [suffixes[len(suffixes) * i // buckets : len(suffixes) * (i + 1) // buckets] for i in range(buckets)]
        suffixes = []
        for part in parts:
            for b in S._sorted_bucket(by_before)([batch(part, schema)]):
                for r in b.to_pylist():
                    if r["window"] is not None:
                        windows.append((r["window"], r["doc"], r["low"]))
                    elif r["after"] is not None:
                        suffixes.append({c: r[c] for c in schema.names})
                    else:
                        ranges.append((r["doc"], r["low"], r["high"]))
    first = {}
    for w, d, low in sorted(windows):
        if first.setdefault(w, (d, low)) != (d, low):
            ranges.append((d, low, low))
    texts = [{"doc_id": d, "text": t or "", "ranges": [{"low": a, "high": b} for e, a, b in ranges if e == d]} for d, t in rows]
    return [tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for b in S._cut(False)([pa.RecordBatch.from_pylist(texts)]) for r in b.to_pylist()]


@pytest.mark.parametrize("tile, together, buckets", [(S.TILE, S.TOGETHER, 1), (300, 1, 7), (S.TILE, 1, 60), (300, S.TOGETHER, 25)])
def test_equals_brute_force(monkeypatch, tile, together, buckets):
    rows = corpus()
    monkeypatch.setattr(S, "TILE", tile)
    monkeypatch.setattr(S, "TOGETHER", together)
    # a batch of its own for each text, so that little is settled locally
    monkeypatch.setattr(S, "slices", lambda texts, most: ((i, 1) for i in range(len(texts))))
    assert sorted(removed(rows, buckets), key=str) == expected(rows)


def hot(n):
    """A passage in many texts, between words that differ; many copies; periods; zero bytes."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 3)))
    passages = [" ".join(word() for _ in range(k)) for k in (22, 33, 36, 40, 60)]
    texts = [" ".join(word() for _ in range(rng.randint(0, 40))) + rng.choice(passages) + " ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return list(enumerate(texts + texts[:3] * (n // 8) + ["\0" * 130, "a" * 50 + "\0" * 150, "\0" * 99, "ab\0" * 60]))


@pytest.mark.parametrize("buckets", [1, 4, 90])
def test_hot_passages_across_boundaries(monkeypatch, buckets):
    rows = hot(160)
    monkeypatch.setattr(S, "TOGETHER", 1)
    monkeypatch.setattr(S, "slices", lambda texts, most: ((i, 1) for i in range(len(texts))))
    assert sorted(removed(rows, buckets), key=str) == expected(rows)


def test_multikey_order_and_prefixes():
    rng = np.random.default_rng(1)
    table = rng.integers(0, 2, (500, 24)).astype(np.uint8) * rng.integers(0, 2, (500, 1), np.uint8)
    order = S.multikey_order(table)
    rows = [table[i].tobytes() for i in order]
    assert rows == sorted(rows) and sorted(order) == list(range(500))
    common = [0, *(next((j for j in range(24) if a[j] != b[j]), S.LENGTH) for a, b in zip(rows, rows[1:]))]
    assert S.common_prefixes(table, order).tolist() == common


@pytest.mark.parametrize("ids", [(None, None), (2, None), (1 << 62, -(1 << 63)), (-(1 << 63), (1 << 63) - 1)])
def test_operator_with_nulls_ties_extreme_ids_and_clashing_columns(spark, ids):
    rows = corpus() + [(ids[0], "zz " * 60), (ids[0], "yy " * 60), (ids[1], "zz " * 60), (ids[1], "zz " * 60)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, doc string, low int").repartition(3)
    got = [tuple(r) for r in S.remove_repeats(df).collect()]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert sorted(got, key=str) == expected(ordered)


def test_ranges_follow_the_anchors(spark, monkeypatch):
    """With two shuffle partitions and many anchors, a task has no more of them than some ranges', whatever one gram's share."""
    sizes = spark.sparkContext.accumulator(0)
    rows = hot(160)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(S, "TOGETHER", 1)
    monkeypatch.setattr(S, "RANGE_ROWS", 50)
    plain, most = S._shared_grams, 400

    def counted(batches):
        held = list(batches)
        if sum(b.num_rows for b in held) > most:
            raise ValueError("a range of too many anchors")
        sizes.add(1)
        yield from plain(held)

    monkeypatch.setattr(S, "_shared_grams", counted)
    got = [tuple(r) for r in S.remove_repeats(df).collect()]
    assert sizes.value > 10 and sorted(got, key=str) == expected(rows)


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
