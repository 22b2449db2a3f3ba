"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, saved


def smallest_reachable(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node reachable from it. Nodes are longs.
    tasks: so many write each table, if it has a number; else as many as shuffles have.

    Each round points every node to its smallest neighbour or itself, follows pointers twice, and contracts the
    edges; a node that is no pointer's end leaves the graph, so edges shrink by half or more. Rounds are written
    tables; afterwards each round's pointers are applied to the earlier ones. Nodes with very many edges only
    meet partial aggregates and joins that Spark can split.
    """
    few = lambda df: df.coalesce(tasks) if tasks else df
    pair = lambda x, y: F.struct(F.least(x, y).alias("low"), F.greatest(x, y).alias("high"))
    rest = saved(edges.where("a != b").select(pair(F.col("a"), F.col("b")).alias("e")).select("e.*").distinct().transform(few), "edges")
    rounds = []
    while not rest.isEmpty():
        ends = rest.select(F.explode(F.array(F.struct("low", F.col("low").alias("near")), F.struct(F.col("high").alias("low"), F.col("low").alias("near")))).alias("x")).select(F.col("x.low").alias("node"), "x.near")
        to = saved(ends.groupBy("node").agg(F.min("near").alias("to")).transform(few), "pointers")
        step = lambda p, q: p.join(q.select(F.col("node").alias("to"), F.col("to").alias("next")).hint("merge"), "to").transform(few).select("node", F.col("next").alias("to"))
        twice = step(to, to)
        far = saved(step(twice, twice), "pointers")
        moved = lambda df, c: df.join(far.select(F.col("node").alias(c), "to").hint("merge"), c).transform(few).drop(c).withColumnRenamed("to", c)
        new = moved(moved(rest, "low"), "high").where("low != high").select(pair(F.col("low"), F.col("high")).alias("e")).select("e.*").distinct()
        new = saved(few(new), "edges")
        dropped(rest, to)
        rounds.append(far)
        rest = new
    dropped(rest)
    if not rounds:
        return rest.sparkSession.createDataFrame([], "node long, root long")
    found = rounds.pop()
    while rounds:
        earlier, last = rounds.pop(), found
        ends = last.select(F.col("node").alias("to"), F.col("to").alias("root"))
        found = saved(few(earlier.join(ends.hint("merge"), "to", "left")).select("node", F.coalesce("root", "to").alias("to")), "pointers")
        dropped(earlier, last)
    return found.select("node", F.col("to").alias("root"))
