"""Connected components by alternating large-star and small-star steps.

Each step is a map-side combined minimum and a join; neighbour lists are never
gathered, so a node with any number of links is no hot spot beyond a join key,
which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, settle


def _star(pairs: DataFrame) -> DataFrame:
    """(a, b, m): each pair with the least partner of a."""
    return pairs.join(pairs.groupBy("a").agg(F.min("b").alias("m")), "a")


def _two(pairs: DataFrame, *sides: tuple[str, str]) -> DataFrame:
    """(a, b): two pairs of each row.  A union would compute the rows twice, stages and all."""
    return pairs.select(F.inline(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in sides])))


def _settled(pairs: DataFrame) -> bool:
    """Whether no node has two partners below it, or one below and one above, as a
    step would change nothing more."""
    ends = pairs.select(F.inline(F.array(*[F.struct(F.col(x).alias("node"), F.lit(up).alias("up")) for x, up in (("a", 1), ("b", 0))])))
    return ends.groupBy("node").agg(F.sum("up").alias("n"), F.min("up").alias("least")).where("n > 1 or n = 1 and least = 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in ``edges`` (a, b): label is the least node reachable."""
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(now):
        large = _star(_two(now, ("a", "b"), ("b", "a"))).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        step = _two(_star(large), ("a", "m"), ("b", "m")).where("a <> b").distinct()
        done, now = now, settle(step, "edges")
        drop_settled(done)
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
