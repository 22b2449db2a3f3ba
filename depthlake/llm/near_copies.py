"""Near copies by SimHash: texts whose sets of five-word shingles have a Jaccard likeness of 0.8 or more.

Two sets of likeness 0.8 differ in about 10 of 64 bits of a SimHash, too many for balls around all bits. So a set's fingerprint has BITS bits, and TABLES parts of PART bits each, dealt by
a fixed permutation, are hashed as in simhash: every part emits its variants of one bit or none, variants are shuffled, and what meets differs in two
bits of a part at most. Sets of likeness 0.8 meet in a part with probability 0.12, in one of the 32 with 0.98; at 0.85 with 0.998; above that nearly always.
What links is never the estimate: candidate pairs whose whole fingerprints are near enough are compared set by set.
Equal sets are one node from the start. Of a variant's nodes all meet the first, and each the next, but those that are known to be of one group. Each node is compared first with that of what it met whose fingerprint is nearest, which joins a large group of
near copies with one pair a row; then the pairs that components still part are compared. This is done for the first part, which makes most groups known, and then for ever more parts together (STEPS).
Large groups come first on a variant, so its first node is one of theirs and only nodes outside meet it; pairs of sets whose sizes alone rule out the likeness, and pairs of earlier parts, are no candidates.
Texts that share a passage meet by the hundred though few are near. So nodes that have met more than BUSY others bring their fingerprints to the variants of later parts, where what is too far apart for near sets is
dropped before any join: pairs that are joined follow what may be near, not the square of those that share a passage. No pair is lost by it that the same comparison would not drop after the join.
Tables of pairs, links and groups are written by as many tasks as their rows ask for (tasks_of), since there are many of them and most are small.

Defined results: words are those of simhash; null text counts as empty; a text of fewer than WORDS words has one shingle, a text without words the empty one;
rows with a null doc_id all stay, since nothing names them; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import smallest_reachable
from .shared import dropped, filled, partitions, saved, swept, tasks_of, text_of
from .simhash import TASK_ROWS

WORDS, LEAST = 5, 0.8
SEED = 42
#: Bits of a set's fingerprint; parts of them, and bits of a part; parts whose variants are on disk at a time.
BITS, TABLES, PART, TABLES_AT_ONCE = 1024, 32, 32, 4
#: Parts after which groups are made known anew.
STEPS = (1, 4, TABLES)
#: Others that a node has met, over which it brings its fingerprint.
BUSY = 2
#: Bits in which near sets differ, at most: three standard deviations over the mean at LEAST, which all but one in 700 pairs of that likeness keep, and more of the nearer ones.
APART = 189
#: The group of a node that has none but itself, the same for all, so that the shuffle compresses it.
ALONE = -1
#: Where a group's number has the logarithm of its nodes, above the numbers of monotonically_increasing_id for 2^19 partitions.
CLASS = 52
#: Rows of a task that joins fingerprints or writes links, and pairs of texts of a task.
LINKS, TEXTS = 100_000, 1_000
#: Shingles whose bits are counted at a time, and sets that a worker remembers while it compares.
RUN, MOST_SETS = 4096, 64
#: Pairs of fingerprints that a task compares at a time.
PRINTS = 1 << 16

_rng = np.random.default_rng(SEED)
FACTORS = _rng.integers(0, 1 << 63, BITS // 64, np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = _rng.permutation(BITS)[: TABLES * PART].reshape(TABLES, PART)


def shingles(text: bytes) -> np.ndarray:
    """The set of a text's shingles, as sorted 64-bit hashes."""
    import xxhash

    words = text.lower().split()
    found = map(b" ".join, zip(*(words[i:] for i in range(WORDS)))) if len(words) >= WORDS else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(x, SEED) for x in found), np.uint64))


def print_of(own: np.ndarray) -> bytes:
    """The fingerprint of a set: each bit is one if it is set in over half the hashes."""
    ones = np.zeros(BITS, np.int64)
    for first in range(0, len(own), RUN):
        x = own[first : first + RUN, None] * FACTORS
        x ^= x >> np.uint64(32)
        x *= FACTORS
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(own)).tobytes()


def _printed(batches):
    import xxhash

    for batch in batches:
        texts = filled(batch.column("text"))
        rows = []
        for x in texts:
            own = shingles(x.as_py().encode())
            rows.append((xxhash.xxh64_intdigest(own.tobytes(), SEED), len(own), print_of(own)))
        node = pa.array(np.array([r[0] for r in rows], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), node, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), texts], names=["doc_id", "node", "size", "print", "text"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, node, size, print, text): a number of each row's set, its size and its fingerprint."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_printed, "doc_id long, node long, size long, print binary, text string")


def _variants(tables: range):
    """The variants of some parts, with the part's number above their bits, and the fingerprints of busy nodes."""
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(PART, dtype=np.uint64)])

    def emit(batches):
        for batch in batches:
            node, group, size = (batch.column(c).to_numpy() for c in ("node", "group", "size"))
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint8).reshape(-1, BITS // 8), axis=1)
            shown = pc.if_else(batch.column("busy"), batch.column("print"), pa.scalar(None, pa.binary()))
            for t in tables:
                part = np.ascontiguousarray(np.packbits(bits[:, PLACES[t]], axis=1, bitorder="little")).view("<u4").astype(np.uint64).ravel()
                key = (part ^ flips[:, None]) | np.uint64(t << PART)
                own = [pa.array(np.tile(x, len(flips))) for x in (node, group, size)]
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), *own, pa.concat_arrays([shown] * len(flips))], names=["variant", "node", "group", "size", "shown"])

    return emit


def _met(batches):
    """Pairs of nodes of different groups that meet on a variant, and whose sizes, and fingerprints if both bring theirs, near sets may have: each with the first by group and number, and each with the next."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    variant, node, group, size = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("variant", "node", "group", "size"))
    shown = pa.chunked_array([b.column("shown") for b in held])
    place = np.cumsum(valid := pc.is_valid(shown).to_numpy()) - 1  # of a row's fingerprint among those that are there
    place[~valid] = -1
    prints = np.frombuffer(b"".join(shown.drop_null().to_pylist()), np.uint8).reshape(-1, BITS // 8)
    del held, shown
    order = np.argsort(variant)
    alone = np.ones(len(order) + 1, bool)
    alone[1:-1] = variant[order[1:]] != variant[order[:-1]]
    order = order[~(alone[:-1] & alone[1:])]  # most variants have one node
    variant, node, group, size, place = (x[order] for x in (variant, node, group, size, place))
    group = np.where(group == ALONE, node, group)
    order = np.lexsort((node, group, variant))
    variant, node, group, size, place = (x[order] for x in (variant, node, group, size, place))
    at = np.arange(len(node))
    first = np.ones(len(node), bool)
    first[1:] = variant[1:] != variant[:-1]
    head = np.maximum.accumulate(np.where(first, at, 0))
    star, chain = group[head] != group, ~first
    chain[1:] &= group[1:] != group[:-1]
    pairs = np.concatenate([np.stack([head[star], at[star]]), np.stack([at[chain] - 1, at[chain]])], axis=1)
    pairs = pairs[:, size[pairs].min(axis=0) >= LEAST * size[pairs].max(axis=0)]
    fit = np.ones(pairs.shape[1], bool)
    both = np.flatnonzero(place[pairs].min(axis=0) >= 0)
    for own in np.split(both, range(PRINTS, len(both), PRINTS)):
        p, q = prints[place[pairs[:, own]]]
        fit[own] = _apart(p, q) <= APART
    pairs = np.unique(np.sort(node[pairs[:, fit]], axis=0), axis=1)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The bits in which fingerprints differ."""
    return np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64)


def _fitting(batches):
    """The pairs whose sizes and fingerprints may be those of near sets."""
    for batch in batches:
        p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BITS // 8) for c in ("a_print", "b_print"))
        x, y = batch.column("a_size").to_numpy(), batch.column("b_size").to_numpy()
        apart = _apart(p, q)
        fit = (apart <= APART) & (np.minimum(x, y) >= LEAST * np.maximum(x, y))
        own = [*(batch.column(c) for c in ("a_node", "b_node")), pa.array(apart)]
        yield pa.RecordBatch.from_arrays(own, names=["a", "b", "apart"]).filter(pa.array(fit))


def candidates(nodes: DataFrame, tables: range = range(TABLES), earlier: tuple[DataFrame, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, apart) of a table (node, at, group, busy, size, print), a < b, that met in some parts, are of different groups and may be near; apart: the bits in which they differ.
    at, group: small numbers of each node and its group, which take less room in the shuffle. earlier: tables of pairs of numbers that met before and aren't wanted again.
    The results are written tables: these pairs, and those of numbers that met for the first time."""
    spark = nodes.sparkSession
    count, busy = nodes.agg(F.count("*"), F.count_if("busy")).first()
    # a row with its fingerprint has five times the bytes of one without; of many such rows fewer parts are on disk at a time
    at_once = max(1, TABLES_AT_ONCE // max(1, -(-8 * busy // max(1, count))))
    tasks = max(partitions(spark), -(-(count + 4 * busy) * (PART + 1) * at_once // TASK_ROWS))
    group = F.when(F.col("group") == F.col("at"), ALONE).otherwise(F.col("group")).alias("group")
    spread = nodes.select(F.col("at").alias("node"), group, "busy", F.col("size").cast("int").alias("size"), "print").repartition(partitions(spark))
    shares = []
    for first in range(tables.start, tables.stop, at_once):
        variants = spread.mapInArrow(_variants(range(first, min(first + at_once, tables.stop))), "variant long, node long, group long, size int, shown binary")
        shares.append(saved(variants.repartition(tasks, "variant").mapInArrow(_met, "a long, b long"), "met"))
        swept(spark)
    pairs = functools.reduce(DataFrame.union, shares)
    few = tasks_of(spark, pairs.count(), LINKS)
    pairs = pairs.distinct()
    if earlier:
        pairs = pairs.join(functools.reduce(DataFrame.union, earlier).hint("merge"), ["a", "b"], "left_anti")
    pairs = saved(pairs.coalesce(few), "new")
    dropped(*shares)
    side = lambda c: nodes.select(F.col("at").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("node", "size", "print"))).hint("merge")
    fitting = pairs.join(side("a"), "a").coalesce(few).join(side("b"), "b").coalesce(few).mapInArrow(_fitting, "a long, b long, apart long")
    return saved(fitting.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "apart"), "pairs"), pairs


def _compared(batches):
    known: dict[int, np.ndarray] = {}

    def own(node: int, text: str) -> np.ndarray:
        if node not in known:
            if len(known) >= MOST_SETS:
                known.clear()
            known[node] = shingles(text.encode())
        return known[node]

    for batch in batches:
        a, b, a_text, b_text = (batch.column(c) for c in ("a", "b", "a_text", "b_text"))
        likeness = []
        for i, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist())):
            p, q = own(x, a_text[i].as_py()), own(y, b_text[i].as_py())
            shared = len(np.intersect1d(p, q, assume_unique=True))
            likeness.append(shared / (len(p) + len(q) - shared))
        yield pa.RecordBatch.from_arrays([a, b, pa.array(likeness, pa.float64())], names=["a", "b", "likeness"])


def compared(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b, likeness): the Jaccard likeness of pairs (a, b) of nodes, from one text of each."""
    few = tasks_of(pairs.sparkSession, pairs.count(), TEXTS)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = saved(rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")).coalesce(few), "candidates")
    text = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"{c}_text"))
    both = pairs.join(text("a").hint("merge"), "a").coalesce(few).join(text("b").hint("merge"), "b").coalesce(few)
    return both.select("a", "b", "a_text", "b_text").mapInArrow(_compared, "a long, b long, likeness double")


def groups(rows: DataFrame) -> DataFrame:
    """(node, root) of the nodes of rows (node, size, print, text) that are near another: the components of all near pairs among the candidates."""
    nodes = saved(rows.groupBy("node").agg(F.first("size").alias("size"), F.first("print").alias("print")).withColumn("at", F.monotonically_increasing_id()), "nodes")
    known = roots = None
    earlier: tuple[DataFrame, ...] = ()
    for first, last in zip((0, *STEPS), STEPS):
        grouped = nodes.withColumns({"group": F.col("at"), "busy": F.lit(False)}) if roots is None else _grouped(nodes, roots, earlier)
        pairs, met = candidates(grouped, range(first, last), earlier)
        if roots is not None:
            dropped(grouped, roots)
        known, roots = _joined(pairs, known, rows)
        dropped(pairs)
        swept(rows.sparkSession)
        earlier += (met,)
    dropped(*earlier)
    return roots


def _grouped(nodes: DataFrame, roots: DataFrame, earlier: tuple[DataFrame, ...] = ()) -> DataFrame:
    """nodes with group: the number of their root, less as many times 2^CLASS as the logarithm of the group's nodes, which puts larger groups first; and with busy: whether they have met more than BUSY others."""
    few = tasks_of(nodes.sparkSession, nodes.count(), LINKS)
    counts = roots.groupBy("root").agg(F.count("*").alias("n")).coalesce(few)
    number = F.col("at") - F.shiftleft(F.floor(F.log2("n")).cast("long"), CLASS)
    numbers = nodes.select(F.col("node").alias("root"), "at").join(counts.hint("merge"), "root").coalesce(few).select("root", number.alias("group"))
    known = roots.join(numbers.hint("merge"), "root").coalesce(few).select("node", "group")
    met = functools.reduce(DataFrame.union, (pairs.select(F.col(c).alias("at")) for pairs in earlier for c in ("a", "b")), nodes.select("at").limit(0))
    busy = met.groupBy("at").agg((F.count("*") > BUSY).alias("busy")).where("busy").coalesce(few)
    grouped = nodes.join(known.hint("merge"), "node", "left").coalesce(few).join(busy.hint("merge"), "at", "left").coalesce(few)
    return saved(grouped.withColumns({"group": F.coalesce("group", "at"), "busy": F.coalesce("busy", F.lit(False))}), "grouped")


def _joined(pairs: DataFrame, known: DataFrame | None, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links known and those of candidate pairs as far as components need them, and the roots that follow."""
    few = tasks_of(pairs.sparkSession, pairs.count() + (0 if known is None else known.count()), LINKS)
    more = lambda df: df if known is None else known.union(df)
    star = saved(pairs.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("first")).select("first.a", "b").coalesce(few), "star")
    near = F.col("likeness") >= LEAST
    first = saved(more(compared(star, rows).where(near).select("a", "b")), "near")
    # what is still in more than one component
    roots = saved(smallest_reachable(first, few).coalesce(few), "roots")
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")).hint("merge")
    parted = pairs.join(star.hint("merge"), ["a", "b"], "left_anti").coalesce(few).join(root("a"), "a", "left").coalesce(few).join(root("b"), "b", "left")
    parted = saved(parted.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b").coalesce(few), "parted")
    found = saved(first.union(compared(parted, rows).where(near).select("a", "b")), "near")
    dropped(star, first, parted, roots, *([] if known is None else [known]))
    return found, saved(smallest_reachable(found, few).coalesce(few), "roots")


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every row: the smallest doc_id of its group of near copies."""
    rows = saved(signatures(docs), "signatures")
    roots = groups(rows)
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    member = saved(nodes.join(roots.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first_id"), "members")
    smallest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = member.join(smallest.hint("merge"), "root").select("node", "component_id")
    return rows.select("doc_id", "node").join(found.hint("merge"), "node").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group of near copies: that with the smallest doc_id, with its columns. Of rows that share that doc_id the
    first by text stays; rows with a null doc_id all stay."""
    place = F.col("doc_id").cast("long").alias("place")
    stay = near_components(docs).where(F.col("doc_id") == F.col("component_id")).select(place).distinct()
    rows = docs.select(place, F.struct("*").alias("row"), text_of().alias("text"))
    same = Window.partitionBy("place").orderBy("text")
    named = rows.join(stay, "place").withColumn("copy", F.row_number().over(same)).where("copy = 1").select("row.*")
    return named.unionByName(docs.where(F.col("doc_id").isNull()))
