"""Connected components of an edge table, by alternating stars; every step is a join or an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clinspark.session import stage_table


def _pairs(edges: DataFrame) -> DataFrame:
    """Distinct edges as (u, v) with u > v."""
    return (
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours under the smallest node it sees."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("low", "u").alias("low"))
    # Written before the join on the same column, so that a node with very many neighbours can be split there.
    low = stage_table(low, "low")
    return both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hangs itself and its smaller neighbours under the smallest of them."""
    low = stage_table(edges.groupBy("u").agg(F.min("v").alias("low")), "low")
    hung = edges.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return hung.unionByName(low.select("u", F.col("low").alias("v")))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge; others are left out.

    Rounds are written to the shared folder, so a lost executor costs one round at most; the number of rounds grows
    with the logarithm of the largest component.  A null end is no edge.
    """
    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        table = stage_table(_pairs(df), "edges")
        mark = table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return table, tuple(mark)

    now, mark = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna())
    while mark[0]:
        after, new = written(_small_star(stage_table(_pairs(_large_star(now)), "stars")))
        done = new == mark
        now, mark = after, new
        if done:
            break
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
