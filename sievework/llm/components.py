"""Connected components of a graph given as a table of links.

Alternating star contraction: in turn every node links its larger neighbours
to the smallest node of its neighbourhood, then itself and its smaller
neighbours to their smallest.  The links only ever shrink to stars; a few
rounds are enough for long chains as well.  Minima are aggregated before the
shuffle and joined back, so a node with very many links is never gathered in
one task, and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.shared import drop, written

MAX_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One contraction; ``links`` holds (a, b) with a > b."""
    if large:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    joined = near.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link to another; component is the smallest node reachable.

    Links may repeat, point either way or to themselves; links with a null end are ignored.
    """
    spark = links.sparkSession
    whole = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = whole.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    current, path = written(pairs.filter(F.col("a") > F.col("b")).distinct(), "links")
    seen = None
    for _ in range(MAX_ROUNDS):
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        after, next_path = written(_star(_star(current, True), False), "links")
        drop(spark, path)
        current, path = after, next_path
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
