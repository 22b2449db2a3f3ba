"""Merkle manifest of a dataset: a tree over the rows of each group, and one over the groups' roots.

A level of a tree is kept as one hex string for each aligned block of nodes: SQL cuts of a fixed width hash the parents of a block, level by level, up to
the block's own root; the cuts beside a node's are its siblings. The roots of the blocks are the nodes of a tree in turn, until one block holds all. Then segments of siblings come
down the same way: a block's node has those inside the block, then those of the block. So a row is shuffled once into its place and once into its block,
with a few hundred bytes, whatever its text; a group of any size is so many blocks.

Defined results: a null field is `-`, an empty text `0:`; a null group comes first, a null doc_id before all others; rows with one doc_id follow by their leaf, and equal rows
in any order, which gives them the same nodes; a group of one row has its leaf as root, a dataset of one group that group's root; without siblings the proof is that of the
empty text; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from .shared import dropped, partitions, saved

#: Levels of a tree inside a block, nodes of a block, hex digits of a node.
DEEP, WIDTH = 8, 64
BLOCK = 1 << DEEP
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Which rows' n_chars is changed to see whether the tree notices: those whose checksum this divides.
EVERY = 7
PATH = "array<struct<left:boolean,node:string>>"


def digest(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field as its number of bytes, a colon and its value, or a dash."""
    text = [x.cast("string") for x in fields]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in text)))


def tree_key(group: Column) -> Column:
    """A group as a key that is never null and sorts as it does, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (tree, ...) with pos, their place in their tree by order, and n, the tree's rows; a table of it is written.

    Ranges of all trees are sorted and written; a row's place is its number in its file and what the tree has in the files before.
    """
    spark = rows.sparkSession
    sort = ["tree", *order, "_row"]
    # saved first: dealing by ranges reads its input twice
    known = saved(rows.withColumn("_row", F.monotonically_increasing_id()), "unplaced")
    dealt = known.repartitionByRange(partitions(spark), *sort).sortWithinPartitions(*sort)
    path = scratch(spark, "ranges")
    dealt.drop("_row").withColumn("_range", F.spark_partition_id()).write.option("compression", "zstd").parquet(path)
    # a range has more than one file where the session limits the rows of a file
    kept = spark.read.schema(", ".join(f"`{x}` {kind}" for x, kind in [*rows.dtypes, ("_range", "int")])).parquet(path)
    kept = kept.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    files = kept.groupBy("tree", "_range", "_file").agg(F.min("_index").alias("_first"), F.count(F.lit(1)).alias("_n"))
    tree = Window.partitionBy("tree")
    earlier = tree.orderBy("_range", "_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("tree", "_range", "_file", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_offset"), F.sum("_n").over(tree).alias("n"))
    found = kept.join(offsets, ["tree", "_range", "_file"]).withColumn("pos", F.col("_index") + F.col("_offset"))
    out = saved(found.drop("_range", "_file", "_index", "_offset"), "placed")
    kept.saved_at = path
    dropped(known, kept)
    return out


def _cut(level: Column, at: Column) -> Column:
    """The node at a place of a level, empty beyond its end. As bytes, where a cut doesn't read what is before it."""
    return F.substring(level, at * WIDTH + 1, F.lit(WIDTH))


def _parents(level: Column) -> Column:
    """The level above: every two nodes' digest, one string."""
    pairs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / (2 * WIDTH)).cast("int"))
    return F.array_join(F.transform(pairs, lambda i: digest(F.substring(level, i * (2 * WIDTH) + 1, F.lit(2 * WIDTH)))), "").cast("binary")


def blocks(nodes: DataFrame, *carry: str) -> DataFrame:
    """(tree, block, n, nodes, levels, root) of nodes (tree, pos, n, node, ...): the nodes of each aligned block in order, with what they carry, its levels as strings, and its root."""
    own = nodes.groupBy("tree", F.shiftright("pos", DEEP).alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct("pos", "node", *carry))).alias("nodes"))
    size = F.col("n").cast("int")
    # a tree of one block ends at its root; the last block of others is hashed as often as the rest
    steps = F.when(F.col("n") > BLOCK, F.lit(DEEP)).when(size == 1, F.lit(0)).otherwise(F.length(F.bin(size - 1)))
    first = F.array(F.array_join(F.transform("nodes", lambda x: x.node), "").cast("binary"))
    up = F.aggregate(F.sequence(F.lit(1), F.col("steps")), first, lambda levels, _: F.concat(levels, F.array(_parents(F.element_at(levels, -1)))))
    own = own.withColumn("steps", steps).withColumn("levels", F.when(F.col("steps") > 0, up).otherwise(first))
    return own.select("tree", "block", "n", "nodes", "levels", F.element_at("levels", -1).cast("string").alias("root"))


def _segment(levels: Column, at: Column) -> Column:
    """The siblings of a block's node, level by level: where they stand and what they are, empty where a last node is alone."""

    def beside(k: Column) -> Column:
        # in SQL, since shiftright of a lambda's variable is not in the functions
        own = F.floor(at / F.pow(F.lit(2), k)).cast("long")
        left = own % 2 == 1
        return F.struct(left.alias("left"), _cut(F.get(levels, k), F.when(left, own - 1).otherwise(own + 1).cast("int")).cast("string").alias("node"))

    none = F.array().cast(PATH)
    return F.when(F.size(levels) > 1, F.transform(F.sequence(F.lit(0), F.size(levels) - 2), beside)).otherwise(none)


def grown(nodes: DataFrame, *carry: str) -> list[DataFrame]:
    """Tables of blocks, from those of the nodes (tree, pos, n, node) up: the roots of one table's blocks are the nodes of the next."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    out = [saved(blocks(nodes, *carry), "blocks")]
    while most > BLOCK:
        above = out[-1].where(F.col("n") > BLOCK).select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("root").alias("node"))
        out.append(saved(blocks(above), "blocks"))
        most = -(-most // BLOCK)
    return out


def tree_roots(tables: list[DataFrame]) -> DataFrame:
    """(tree, root) of the trees of grown()."""
    out = None
    for table in tables:
        own = table.where(F.col("n") <= BLOCK).select("tree", "root")
        out = own if out is None else out.union(own)
    return out


def paths(tables: list[DataFrame], tops: DataFrame, *carry: str) -> DataFrame:
    """(tree, pos, node, path, ...) of the nodes of grown(): path has the siblings up to the tree's root, then those of tops (tree, path, ...), the trees' own, whose other columns are passed down."""
    passed = [c for c in tops.columns if c not in ("tree", "path")]
    above = None
    for i, table in reversed(list(enumerate(tables))):
        own = table.select("tree", "block", "n", "nodes", "levels")
        done = own.where(F.col("n") <= BLOCK).join(tops, "tree")
        if above is not None:
            more = own.where(F.col("n") > BLOCK).join(above.select("tree", F.col("pos").alias("block"), "path", *passed), ["tree", "block"])
            done = done.unionByName(more)
        each = done.select("tree", "levels", "path", *passed, F.explode("nodes").alias("x"))
        inside = _segment(F.col("levels"), F.col("x.pos") % BLOCK)
        above = each.select("tree", F.col("x.pos").alias("pos"), F.col("x.node").alias("node"), *(F.col(f"x.{c}").alias(c) for c in (carry if i == 0 else ())), F.concat(inside, "path").alias("path"), *passed)
    return above


def folded(node: Column, path: Column) -> Column:
    """The root that follows from a node and its siblings."""
    return F.aggregate(path, node, lambda own, x: digest(F.when(x.left, F.concat(x.node, own)).otherwise(F.concat(own, x.node))))


def proof_digest(path: Column) -> Column:
    """One digest of all siblings, from the node up."""
    return digest(F.array_join(F.transform(path, lambda x: x.node), ""))


def manifest(docs: DataFrame, changed: Column | None = None, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id") -> DataFrame:
    """(order, leaf, offered, path, subroot, root) of every row: its digest, its siblings up to the root of all, the root of its group and that of all.

    changed: how the row would be digested when it is offered for verification; as it is by default. A row is as it was when folded(offered, path) is root.
    """
    own = leaf(*(F.col(x) for x in fields))
    rows = docs.select(tree_key(F.col(group)).alias("tree"), F.col(order), own.alias("node"), (own if changed is None else changed).alias("offered"))
    leaves = placed(rows, [order, "node", "offered"])
    tables = grown(leaves, order, "offered")
    dropped(leaves)
    groups = placed(tree_roots(tables).select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("root").alias("node")), ["group"])
    upper = grown(groups, "group")
    root = tree_roots(upper).select("tree", F.array().cast(PATH).alias("path"), "root")
    tops = saved(paths(upper, root, "group").select(F.col("group").alias("tree"), "path", F.col("node").alias("subroot"), "root"), "tops")
    dropped(groups, *upper)
    found = paths(tables, tops, order, "offered")
    return found.select(order, F.col("node").alias("leaf"), "offered", "path", "subroot", "root")


def write_manifest(docs: DataFrame, path: str, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id") -> None:
    """The manifest as a table: whoever has a row of it can verify one row of the dataset against the root, with no other row."""
    manifest(docs, None, fields, group, order).drop("offered").write.parquet(path)


def verified(docs: DataFrame, known: DataFrame, fields: tuple[str, ...] = FIELDS, order: str = "doc_id") -> DataFrame:
    """(order, verified) of rows offered against a manifest of distinct order: false for those that were changed or are not in it."""
    offered = docs.select(order, leaf(*(F.col(x) for x in fields)).alias("offered"))
    return offered.join(known.select(order, "path", "root"), order, "left").select(order, F.coalesce(folded(F.col("offered"), F.col("path")) == F.col("root"), F.lit(False)).alias("verified"))


def manifest_digest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, where every seventh row or so is offered with one more in n_chars."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % EVERY == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    as_is = [F.col(x) for x in FIELDS]
    longer = [F.col("n_chars").cast("decimal(20,0)") + 1 if x == "n_chars" else F.col(x) for x in FIELDS]
    rows = manifest(docs, F.when(tampered, leaf(*longer)).otherwise(leaf(*as_is)))
    again = rows.withColumn("folded_root", folded(F.col("offered"), F.col("path")))
    return again.select(F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
