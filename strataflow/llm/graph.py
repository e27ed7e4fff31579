"""Connected components of a table of links, by shuffles alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.session import materialise


#: Rows of a small table that one task takes.
ROWS_A_TASK = 20_000
#: Links, at most, of which a round may send a side to every task; files of many repeated nodes are much smaller than their rows.
BROADCAST = 250_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many partitions as ``rows`` rows need, and no more than it has: small steps then start few tasks."""
    return df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b); the component is its smallest node.

    Alternates two steps until nothing changes: larger neighbours move to the smallest neighbour, then
    smaller ones do. Each halves long chains, a hub's links are summed before the shuffle, and every round is a
    written table, so a lost executor costs only its own tasks. A round has no more links than the one before, and a
    table of few links is worked on by few tasks. No links give an empty table.
    """
    pairs = materialise(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    told = None
    while True:
        # the links as a set: their number and two sums of hashes
        marks = [F.sum(F.xxhash64("a", "b", F.lit(i)).cast("decimal(20,0)")) for i in range(2)]
        now = tuple(pairs.agg(F.count(F.lit(1)), *marks).first())
        if now == told:
            break
        told, rows = now, now[0]
        pairs = gathered(pairs, rows)
        both = pairs.union(pairs.select(F.col("b"), F.col("a"))).toDF("u", "v").coalesce(max(1, -(-rows // ROWS_A_TASK)))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        least = least.hint("merge") if rows > BROADCAST else least
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = gathered(materialise(gathered(large, rows)), rows)
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(smallest.hint("merge") if rows > BROADCAST else smallest, "a").select("b", "m").where(F.col("b") != F.col("m")).toDF("a", "b")
        pairs = materialise(gathered(joined.union(smallest.select("a", F.col("m").alias("b"))).distinct(), rows))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.select("b", "b").distinct())
