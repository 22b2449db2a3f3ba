"""Units, anchors and likeness against a plain definition, at all lengths; ranges with outliers and frequent ids."""

import hashlib
import random
import re
from collections import Counter

import xxhash

from depthlake.llm import syncmers

WHITE = "\x20\x09-\x0d"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def combined(*longs):
    """xxhash64 of longs, one after the other, as Spark's function chains it."""
    seed = 42
    for x in longs:
        seed = xxhash.xxh64_intdigest((x % (1 << 64)).to_bytes(8, "little"), seed)
    return signed(seed)


def plain_anchors(text):
    units = []
    for word in re.findall(f"[^{WHITE}]+", text):
        at = 0
        while at < len(word):
            size = 1 if len(word) - at > syncmers.LONG else 3
            units.append(word[at : at + size])
            at += size
    h = [0] * 4 + [signed(xxhash.xxh64_intdigest(u.encode(), 42)) for u in units] + [0] * 4
    g = [combined(a, b) for a, b in zip(h, h[1:])]
    out = []
    for i in range(len(h) - 4):
        if min(g[i], g[i + 3]) <= min(g[i + 1], g[i + 2]):
            out.append((combined(g[i], h[i + 2], g[i + 3]) & 0xFFFFFFFF, i - 4))
    return out


def plain_likeness(a, b):
    x, y = (Counter(h for h, _ in plain_anchors(t)) for t in (a, b))
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))


def order(rows):
    tie = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) >> 11
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1] or ""), r[1] or ""))


def check(spark, rows, parts=3):
    """The whole result against the plain definition."""
    found = syncmers.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
    known, ordered = [], order(rows)
    for (d, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1]):
        t, u = t or "", u or ""
        edited = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        prints = ["".join(f"{h:08x}" for h in sorted({h for h, _ in plain_anchors(x)})[: syncmers.SKETCH]) for x in (t, edited)]
        known.append((str(d), len(t), hashlib.sha256(edited.encode()).hexdigest(), *prints, round(plain_likeness(t, edited), 9), round(plain_likeness(t, u), 9)))
    assert sorted((str(r[0]), *r[1:5], round(r[5], 9), round(r[6], 9)) for r in found) == sorted(known)
    return {r.doc_id: r for r in found}


def prose(rng, letters):
    text = ""
    while len(text) < letters:
        text += rng.choice(["river", "a", "stone", "ünder", "walking", "日本", "to"]) + str(rng.randint(0, 99)) + rng.choice([" ", " ", "\n", "  "])
    return text[:letters]


def test_all_lengths_beside_short_and_empty_texts(spark):
    rng = random.Random(2)
    rows = []
    for n in range(0, 1001, 3):
        rows += [(4 * n, prose(rng, n)), (4 * n + 1, ["", "short", None, prose(rng, 200), " "][n % 5])]
    found = check(spark, rows)
    assert min(found[4 * n].near_edited for n in range(60, 1001, 3)) > 0.5


def test_edge_texts(spark):
    rng = random.Random(5)
    unspaced = "".join(rng.choices("abcdefghijklmnop", k=900))
    texts = ["", " ", "a", "ab", "abc d", None, "word " * 500, "x" * 3000, unspaced, unspaced[:450] + "xyz" + unspaced[450:], "w" * 24, "w" * 25, "q" * 23 + " " + "q" * 49, "😀" * 60 + " é"]
    found = check(spark, list(enumerate(texts)))
    assert found[8].near_next > 0.9 and found[6].near_edited > 0.6


def test_outliers_repeats_and_frequent_ids(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE_ROWS", 7)
    rng = random.Random(3)
    rows = [(i, f"text {i} {rng.random()}") for i in range(60)] + [(1 << 62, "far"), (-(1 << 63), "least"), ((1 << 63) - 1, "most"), (9, "text again")]
    rows += [(17, f"same id {i % 30}") for i in range(60)] + [(None, f"no id {i}") for i in range(40)] + [(17, "same row")] * 20
    check(spark, rows)
    sizes = syncmers.with_ranges(spark.createDataFrame([(r[0], r[1]) for r in rows if r[1] != "same row"], "doc_id long, text string")).groupBy("range").count().collect()
    assert len(sizes) > 10 and max(r["count"] for r in sizes) <= 40
    check(spark, rows[:1])
    assert syncmers.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_all_anchors_with_places(spark):
    rng = random.Random(3)
    words = [str(rng.random()) for _ in range(6300)]
    common, one, two = words[:300], words[300:3300], words[3300:]
    texts = [" ".join(one + common), " ".join(common + two)]
    rows = syncmers.fingerprints(spark.createDataFrame([(x,) for x in texts], "text string")).collect()
    assert [[(p.hash, p.place) for p in r.places] for r in rows] == [plain_anchors(x) for x in texts]
    first, second = ({p.hash: p.place for p in r.places} for r in rows)
    assert len({first[h] - second[h] for h in first.keys() & second.keys()} ^ {sum(-(-len(w) // 3) for w in one)}) < 20
    assert all(len(r.anchors) > syncmers.SKETCH for r in rows)
