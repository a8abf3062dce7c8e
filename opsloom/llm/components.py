"""Connected components of a table of links, by labels that shrink to the smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.workspace import Workspace


def connected(space: Workspace, links: DataFrame, name: str, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id that has a link; component is the smallest id it reaches.

    Each round takes the smallest label among an id's neighbours and then
    follows labels once, so long chains shorten by powers of two. Rounds are
    written, which cuts lineage; an id with very many links is pre-aggregated
    and its joins are between plain scans, which adaptive execution can split.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = space.save(both.union(both.select("v", "u")).filter("u <> v").distinct(), f"{name}-edges")
    labels = space.save(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("l")), f"{name}-0")
    total, k = labels.agg(F.sum(F.col("l").cast("decimal(38,0)"))).first()[0], 0
    while total is not None:
        near = edges.join(labels.withColumnRenamed("u", "v"), "v").select("u", "l")
        step = space.save(near.union(labels).groupBy("u").agg(F.min("l").alias("l")), f"{name}-{k}n")
        jump = step.join(step.select(F.col("u").alias("l"), F.col("l").alias("ll")), "l", "left")
        new = space.save(jump.select("u", F.least("l", F.coalesce("ll", "l")).alias("l")), f"{name}-{k + 1}")
        space.drop(f"{name}-{k}", f"{name}-{k}n")
        k += 1
        now = new.agg(F.sum(F.col("l").cast("decimal(38,0)"))).first()[0]
        labels, done, total = new, now == total, now
        if done:
            break
    space.drop(f"{name}-edges")
    return labels.select(F.col("u").alias("id"), F.col("l").alias("component"))
