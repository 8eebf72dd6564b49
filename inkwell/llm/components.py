"""Connected components of links, by large-star and small-star steps (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.shared import ROWS_A_TASK, few, saved


#: Vertices with more than this part of all links at most are told by a broadcast.
HUBS = 1000


def told(links: DataFrame, n: int) -> DataFrame:
    """u, v and m, the smallest v of its u, from links (u, v), 2 * n at most.

    Where a vertex has more than one HUBS-th of them, of which there are fewer than HUBS, m comes by a broadcast, so that its links
    stay where they are.  Links that are one task's work in all need no such care.
    """
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k"))
    if n <= ROWS_A_TASK:
        return links.join(least.select("u", "m"), "u")
    hubs = F.broadcast(least.where(F.col("k") > 2 * n / HUBS).select("u", "m"))
    return links.join(hubs, "u").unionByName(links.join(hubs.select("u"), "u", "left_anti").join(least.select("u", "m"), "u"))


def settled(edges: DataFrame) -> bool:
    """Whether each u has one v and no v is a u, so that all point at their component's smallest id."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out > 0 and into > 0").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component (the smallest id that links reach), one row for each id in a link.

    links: pairs of bigint, either way round, repeats allowed; a null end or a pair of one id links nothing.
    Each round replaces links by fewer or shorter ones, so that they never outgrow the input, until all
    point at their component's smallest id; the number of rounds goes with the logarithm of the longest path.
    A vertex with very many links is summed by a partial minimum and never gathered in one place (see told()).
    """
    n = links.count()  # no step has more than twice as many rows
    edges = few(links, n).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    edges = saved(few(edges, n))
    while not settled(edges):
        # large star: a vertex links its larger neighbours to the smallest vertex that it sees
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = told(both, n).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = few(few(large.where("u <> v"), n).distinct(), n)
        # small star: a vertex links itself and its smaller neighbours to the smallest of them
        small = told(large, n)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        edges = saved(few(few(small, n).distinct(), n))
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
