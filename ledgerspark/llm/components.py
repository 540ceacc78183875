"""Connected components of a table of links, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(u, v, least): least is the smallest of u and all its neighbours. The minimum combines before the shuffle, so a hub with any number of links is a join on its key, which Spark splits when it is skewed."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("least")), "u").select("u", "v", F.least("u", "least").alias("least"))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b) -> (id, component): for each id with a link, the smallest id it can reach.

    Large-star and small-star rounds: each node hangs its larger, then its smaller neighbours on the least of them, so
    trees flatten in about log(n) rounds. Rounds end when the table of links stays as it is, seen from two sums; the
    links themselves stay in the cluster. Links of an id to itself and repeated ones change nothing. No links, no rows.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(edges)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v").distinct()
        small = _least_neighbour(large)
        small = small.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(small.select("u", F.col("least").alias("v"))).filter("u <> v").distinct()
        before, edges = edges, written(small, "links")
        forget(before)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    of = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return of.unionByName(of.select(F.col("component").alias("id"), "component").distinct())
