"""Near copies against all pairs."""

import random

import corpus_pipeline as pipeline

from depthlake.llm import near_copies

SCHEMA = "doc_id long, text string, lang string"


def plain_shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}


def plain_kept(rows):
    sets = [plain_shingles(t) for _, t, _ in rows]
    groups = [{i} for i in range(len(rows))]
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and groups[i] is not groups[j]:
                groups[j] |= groups[i]
                for k in groups[i]:
                    groups[k] = groups[j]
    return sorted({min(rows[k][0] for k in g) for g in groups})


def test_near_copies(spark):
    """Edited copies, which lie more than 3 SimHash bits apart; chains of edits; unrelated, short, equal and empty texts."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = [None, "", "one", "One ", "a b c d", "a b c d e", "A b  c d e"]
    for _ in range(6):
        words = [word() for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(words))
        for _ in range(8):  # each of them edits the one before
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
            texts.append(" ".join(words[: int(len(words) * rng.choice([0.7, 0.85, 0.95]))]))
    rng.shuffle(texts)
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    kept = pipeline.near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(rows)


def test_rows_without_doc_id_stay(spark):
    rows = [(None, "same words here", "en"), (None, "same words here", "en"), (3, "same words here", "en"), (3, "other text", "de"), (4, "Same  words here", "en")]
    found = near_copies.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, found), key=str) == sorted([rows[0], rows[1], rows[3]], key=str)
    assert near_copies.drop_near_copies(spark.createDataFrame([], SCHEMA)).collect() == []


def test_strangers_meet_a_large_group_once(spark):
    """20 nodes that are in no group and a group of 200 with larger numbers, all on the same variants: two pairs for each of the 20, not one for each of the 200; sets of half the size meet none;
    pairs that met before aren't met again."""
    bits = random.Random(3).randbytes(near_copies.BITS // 8)
    rows = [(1000 + i, i, 100 if i < 220 else 50, bits) for i in range(221)]
    nodes = spark.createDataFrame(rows, "node long, at long, size long, print binary")
    roots = spark.createDataFrame([(1000 + i, 1020) for i in range(20, 220)], "node long, root long")
    found, met = near_copies.candidates(near_copies._grouped(nodes, roots), range(1))
    pairs = {tuple(sorted((r.a, r.b))) for r in found.collect()}
    assert len(pairs) == met.count() <= 40
    assert {a for a, b in pairs if a < 1020 <= b} == set(range(1000, 1020))
    again, new = near_copies.candidates(near_copies._grouped(nodes, roots), range(2), (met,))
    assert again.count() == new.count() == 0


def test_busy_nodes_drop_strangers_before_the_join(spark):
    """302 nodes that share the first 8 parts; those that have met many bring their fingerprints, so of all that meet in parts 2 to 8 only the near pair reaches the join."""
    import numpy as np

    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2, (302, near_copies.BITS), np.uint8)
    bits[:, near_copies.PLACES[:8].ravel()] = bits[0, near_copies.PLACES[:8].ravel()]
    bits[300:] = bits[0]  # nodes 300 and 301 are one fingerprint, and far from the others but 0
    rows = [(1000 + i, i, 100, np.packbits(b).tobytes()) for i, b in enumerate(bits)]
    nodes = spark.createDataFrame(rows, "node long, at long, size long, print binary")
    alone = spark.createDataFrame([], "node long, root long")
    earlier = spark.createDataFrame([(0, i) for i in range(1, 302)] * 3, "a long, b long")  # all of them have met more than BUSY
    grouped = near_copies._grouped(nodes, alone, (earlier,))
    assert grouped.where("busy").count() == 302
    found, new = near_copies.candidates(grouped, range(1, 8), (earlier,))
    assert {(r.a, r.b) for r in new.collect()} == {(300, 301)}
    assert {(r.a, r.b, r.apart) for r in found.collect()} == {(1300, 1301, 0)}


def test_small_tables_take_few_tasks(spark):
    """Links of few rows are written by so many tasks, not by one for each partition of a shuffle."""
    from depthlake.llm.components import smallest_reachable

    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        few = near_copies.tasks_of(spark, 40, near_copies.LINKS)
        assert few < 16 == near_copies.tasks_of(spark, 10**9, near_copies.LINKS)
        roots = smallest_reachable(spark.createDataFrame([(1, i) for i in range(2, 42)], "a long, b long"), few)
        assert {tuple(r) for r in roots.collect()} == {(i, 1) for i in range(1, 42)}
        assert len(roots.inputFiles()) <= few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
