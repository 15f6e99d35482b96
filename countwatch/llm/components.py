"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countwatch.llm.common import stage
from countwatch.session import unstage


#: Parts into which the edges of a node are dealt, so that a hub with a third of all edges is that many tasks' work.
PARTS = 256


def with_smallest(edges: DataFrame, parts: int = PARTS) -> DataFrame:
    """(u, v, m): every edge with the smallest v of its u.

    Minima are taken per (u, part), then per u over at most ``parts`` rows, and travel back the same way. No join or
    group is dealt by u alone while it holds the edges themselves, so a hub needs no adaptive splitting.
    """
    dealt = edges.select("u", "v", F.pmod(F.xxhash64("v"), F.lit(parts)).cast("int").alias("part"))
    of_part = dealt.groupBy("u", "part").agg(F.min("v").alias("m"))
    of_node = of_part.groupBy("u").agg(F.min("m").alias("m"))
    known = of_part.select("u", "part").join(of_node, "u")
    return dealt.join(known, ["u", "part"]).select("u", "v", "m")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges, for every node in an edge.

    Each round points every neighbour above a node at the smallest node around it, then does the
    same below. Only minima are kept per node, never a list of neighbours, and a hub's edges are dealt
    over many tasks (``with_smallest``). Rounds end when every edge points at a node that points nowhere,
    which takes a logarithmic number of rounds; the edges of the round before are then deleted. Self-loops
    and null ends are ignored; an empty input gives an empty result.
    """
    now = stage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(),
        "edges",
    )
    while not _is_star_forest(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_smallest(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = with_smallest(large)
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        before, now = now, stage(small.distinct(), "edges")
        unstage(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node that points does so once and nothing points at it."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("points"), F.lit(0).alias("held")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("points"), F.lit(1).alias("held"))
    )
    seen = ends.groupBy("x").agg(F.sum("points").alias("points"), F.max("held").alias("held"))
    return seen.where((F.col("points") > 1) | ((F.col("points") == 1) & (F.col("held") == 1))).isEmpty()
