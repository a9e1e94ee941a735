"""Connected components of a table of links by alternating large-star and small-star steps on DataFrames.

Every step is two shuffles of the links that are left; a node with very many links is handled by a minimum and a join,
never as one list. Each round is written to the shared folder, so the lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (u, v) with u > v, each once. Large: all greater neighbours point to the least one; small: all lesser ones."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least.hint("merge"), "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component for every node that has a link; component is the least node it is connected with.

    links has two bigint columns a and b; their order, repeats and self-links don't matter. No links: no rows.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    size = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = size(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        edges = stored(_star(_star(edges, large=True), large=False), "links")
        if (now := size(edges)) == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
