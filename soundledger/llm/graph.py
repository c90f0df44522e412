"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundledger.llm.common import materialize


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(links: DataFrame, large: bool) -> DataFrame:
    near = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = materialize(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-min")
    met = near.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return materialize(out.filter("u <> v").distinct(), "star-links")


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of links ``(u, v)``; the component is its smallest node.

    Nodes are longs. Self links and links given twice or both ways are fine; null ends are dropped. No links give no rows.
    A node with very many links is minimised before the shuffle, and its links join a written table, so that Spark splits them.
    """
    links = materialize(
        links.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    before = _mark(links)
    while before[0]:
        links = _star(_star(links, large=True), large=False)
        after = _mark(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
