"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.shared import remove_shared, write_shared


#: Parts into which the links of one node are dealt where they meet its least neighbour.
SALTS = 16


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """``links`` with ``least`` of their first node, dealt out by salt."""
    salted = links.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    every = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # no broadcast: the size that Spark knows of is that before the copies
    return salted.join(every.hint("merge"), ["a", "salt"]).drop("salt")


def _large_star(links: DataFrame) -> DataFrame:
    """Link the greater neighbours of each node to its least neighbour."""
    both = links.union(links.select("b", "a")).toDF("a", "b")
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
    return _with_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Link each node and its lesser neighbours to the least of these; a > b throughout."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    moved = _with_least(links, least).where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links``, whose two columns are long.

    The component is the least node that can be reached. Alternating large and small stars
    over distributed tables; every round halves the paths at least, a hub's links are
    folded by sums before they move, and each round is written to the shared folder.
    Links of a node to itself and links with a null count for nothing; repeated links and
    both directions count once. An empty table gives an empty one.
    """
    a, b = links.columns
    state = write_shared(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where("a <> b and a is not null and b is not null").distinct()
    )
    mark = _mark(state)
    while mark[0]:
        turned = write_shared(_small_star(_large_star(state)).distinct())
        before, mark = mark, _mark(turned)
        remove_shared(state)
        state = turned
        if mark == before:
            break
    nodes = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(state.select("b", "b").distinct())


def _mark(links: DataFrame) -> tuple:
    """Rows and a sum over their hashes: equal when a round changed nothing."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
