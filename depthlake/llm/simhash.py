"""SimHash near-dedup by ball hashing that meets in the middle.

Fingerprints are 64 bits over the XXH64 hashes of word shingles. Equal fingerprints are one node from the start. Every node emits all variants within half of RADIUS = 3
bits: those of one bit and itself and, since half of three is one and a half, nodes of even parity also those of two bits that lie in the same half of the fingerprint. Two nodes
that differ in one or two bits share a variant of one bit; of two that differ in three bits one has even parity, and two of the three bits lie in one half, so its
variant with these two flipped is a variant of one bit of the other. Variants are shuffled; whatever is on a variant is within three bits of the nodes that are within
one bit of it, so all of it is linked to the smallest of those: as many links as rows at most, and no link lost. A variant has 1,057 nodes around it
at most, so none is hot. The 561 variants of a node, in the mean, are dealt in SHARES, one after the other, so that only a share is on disk at a time.

Defined results: null text counts as empty; a text with no word has fingerprint zero and links like any other; repeated rows are linked; a row
with a null doc_id gets the component of its fingerprint and never names one, unless all doc_ids there are null, when component_id is null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import smallest_reachable
from .shared import dropped, filled, partitions, saved, swept

RADIUS, WORDS, SEED = 3, 3, 42
#: Shares of the variants that are on disk one after the other, variants of a task, and nodes whose variants are made at once.
SHARES, TASK_ROWS, GROUP = 4, 2_000_000, 256
BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
#: What flips no bit or one, and two bits of the same half.
ONE = np.concatenate([np.zeros(1, np.uint64), BITS])
TWO = np.array([BITS[i] | BITS[j] for i in range(64) for j in range(i) if i // 32 == j // 32])


def fingerprint(text: bytes) -> int:
    """The fingerprint of one text, as a signed 64-bit integer."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z alone is lower-cased, and the six white-space bytes alone split
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS)))) if len(words) >= WORDS else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(x, SEED) for x in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[first : first + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(batches):
    for batch in batches:
        texts = filled(batch.column("text"))
        found = np.fromiter((fingerprint(x.as_py().encode()) for x in texts), np.int64, len(texts))
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found)], names=[*keep, "node"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, node): each document's fingerprint as a long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, node long")


def _rows(variant: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(variant.view(np.int64)), pa.array(node.view(np.int64))], names=["variant", "node"])


def _variants(share: int):
    """A share of the variants of nodes."""

    def emit(batches):
        for batch in batches:
            nodes = batch.column("node").to_numpy().view(np.uint64)
            for first in range(0, len(nodes), GROUP):
                own = nodes[first : first + GROUP]
                even = own[np.bitwise_count(own) % 2 == 0]
                variants = np.concatenate([(own[:, None] ^ ONE).ravel(), (even[:, None] ^ TWO).ravel()])
                owners = np.concatenate([np.repeat(own, len(ONE)), np.repeat(even, len(TWO))])
                keep = (variants * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(62) == share  # SHARES is four
                yield _rows(variants[keep], owners[keep])

    return emit


def _linked(centres, chains: bool):
    """Links between what meets on a variant: all of it to the smallest of centres(variant, node) or, with chains, also each to the next."""

    def link(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        variant, node = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("variant", "node"))
        del held
        order = np.argsort(variant)
        alone = np.ones(len(order) + 1, bool)
        alone[1:-1] = variant[order[1:]] != variant[order[:-1]]
        order = order[~(alone[:-1] & alone[1:])]  # most variants have one node
        variant, node = variant[order], node[order]
        own = centres(variant, node)
        order = np.lexsort((node, ~own, variant))
        variant, node, own = variant[order], node[order], own[order]
        at = np.arange(len(node))
        first = np.ones(len(node), bool)
        first[1:] = variant[1:] != variant[:-1]
        head = np.maximum.accumulate(np.where(first, at, 0))
        hit = own[head] & (at != head)
        pairs = [np.stack([node[head[hit]], node[hit]])]
        if chains:
            hit[1:] &= ~first[:-1]
            hit[:1] = False
            pairs.append(np.stack([node[at[hit] - 1], node[at[hit]]]))
        pairs = np.unique(np.sort(np.concatenate(pairs, axis=1), axis=0), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return link


def met(variants: DataFrame, rows: int, centres, chains: bool = False) -> DataFrame:
    """(a, b): links between the nodes of a table (variant, node) of about so many rows."""
    tasks = max(partitions(variants.sparkSession), -(-rows // TASK_ROWS))
    return variants.repartition(tasks, "variant").mapInArrow(_linked(centres, chains), "a long, b long").distinct()


def _within_one(variant: np.ndarray, node: np.ndarray) -> np.ndarray:
    return np.bitwise_count((variant ^ node).view(np.uint64)) <= 1


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (node) within RADIUS bits: their components are those of all such pairs."""
    spark, rows = nodes.sparkSession, nodes.count() * (len(ONE) + len(TWO) // 2) // SHARES
    spread = nodes.repartition(partitions(spark))
    out = None
    for share in range(SHARES):
        found = saved(met(spread.mapInArrow(_variants(share), "variant long, node long"), rows, _within_one), "links")
        swept(spark)
        out = found if out is None else out.union(found)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = saved(fingerprints(docs), "fingerprints")
    nodes = saved(prints.groupBy("node").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = smallest_reachable(links(nodes.select("node")))
    # the smallest doc_id of a component, through its root
    member = nodes.join(roots.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first_id")
    smallest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = saved(member.join(smallest.hint("merge"), "root").select("node", "component_id"), "members")
    dropped(nodes)
    return prints.join(found.hint("merge"), "node").select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")
