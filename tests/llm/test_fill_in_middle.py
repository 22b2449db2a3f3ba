"""Fill-in-the-middle: forms by plain slices of code points, and exact round trips."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from depthlake.llm import fill_in_middle as fim

SCHEMA = "doc_id long, text string, lang string, form string, n int, prefix_chars string"


def plain(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    p, q = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return text, "plain", n, None, None
    pre, mid, suf = text[:p], text[p:q], text[q:]
    if h4 % 100 < 20:
        return f"<S>{suf}<P>{pre}<M>{mid}", "spm", n, p, q - p
    return f"<P>{pre}<S>{suf}<M>{mid}", "psm", n, p, q - p


def texts():
    rng = random.Random(3)
    return [None, "", "a", "é", "日本", "😀", "<P>", "x<S>y", "<M", "<", "P>", "<P", "line\nline", "\x00\x00", "éé", "x" * 300_000, "日é😀 " * 60_000] + ["".join(rng.choice("ab<PSM>é日😀 ") for _ in range(rng.choice([1, 2, 3, 5, 8, 50, 300]))) for _ in range(400)]


def test_rows(spark):
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts())]
    rows += rows[2:6] + [(-3, "negative"), (1 << 60, "large")]
    docs = spark.createDataFrame([(d, t, "en", "clash", 5, None) for d, t in rows], SCHEMA).repartition(3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    known = sorted(str((d, n, form, p, m, sha(out), sha(t or ""))) for d, t in rows for out, form, n, p, m in [plain(d, t)])
    assert sorted(str(tuple(r)) for r in fim.fill_in_middle_digest(docs).collect()) == known
    out = fim.fill_in_middle(docs)
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(str((d, plain(d, t)[0])) for d, t in rows)
    again = fim.restore_texts(out)
    assert again.columns == docs.columns and sorted(map(str, again.collect())) == sorted(map(str, docs.fillna("", "text").collect()))
    assert {r[fim.FORM] for r in out.collect()} == {"plain", "psm", "spm"}


def test_rotation():
    for n in range(7):
        for a in range(n + 1):
            for b in range(a, n + 1):
                for c in range(b, n + 1):
                    buffer = bytearray(range(n))
                    fim.rotate(buffer, a, b, c)
                    own = list(range(n))
                    assert list(buffer) == own[:a] + own[b:c] + own[a:b] + own[c:]


def test_every_cut():
    text = "aé日😀b"
    raw = text.encode()
    for k in range(6):
        assert fim.byte_places(raw, k) == [len(text[:k].encode())]
    assert fim.byte_places(raw, 0, 5) == [0, len(raw)] and fim.byte_places(b"", 0, 0) == [0, 0]


def test_wrong_outputs():
    for output, form in ((b"no sentinel", "psm"), (b"<P>a<S>b", "psm"), (b"<P>a<S>b<M>", "spm"), (b"", "spm")):
        with pytest.raises(ValueError):
            fim.restored(output, form)
    with pytest.raises(ValueError):
        fim.restored(b"", "other")


def test_empty_table(spark):
    assert fim.fill_in_middle_digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_other_seed(spark):
    docs = spark.createDataFrame([(i, "some text to cut", "en", "", 1, "") for i in range(40)], SCHEMA)
    one, two = ([r.text for r in fim.fill_in_middle(docs, seed=s).orderBy("doc_id").collect()] for s in (1, 2))
    assert one != two and fim.restore_texts(fim.fill_in_middle(docs, seed=2)).select(F.collect_set("text")).first()[0] == ["some text to cut"]
