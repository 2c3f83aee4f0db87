"""Connected components of a table of links by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.llm.common import materialize, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. Each node of links (u > v) hands its neighbours on to the smallest of them.

    The row of the smallest neighbour stands for the node's own link to it, so no second pass over the least ones is joined in.
    Links may come out more than once, no more rows than links and nodes together.
    """
    both = edges.select("u", "v")
    if large:
        both = both.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # By shuffle at every size: links grow with the input, and tables broadcast in each round are made and held by the driver.
    joined = both.join(least.hint("merge"), "u").where("v > u OR v = m" if large else "true")
    out = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(links: DataFrame) -> DataFrame:
    """links(u long, v long) -> (node, root), root the smallest node reachable; nodes without a link are absent.

    Null ends and self links are dropped, repeated links count once, an empty table gives an empty one. Every round is
    a table in the shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    edges = materialize(
        links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    mark = _mark(edges)
    while mark[0]:
        after = materialize(_star(_star(edges, True), False).distinct(), "links")
        release(edges)
        edges, last, mark = after, mark, _mark(after)
        if mark == last:
            break
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(edges.select("v", "v").distinct().toDF("node", "root"))
