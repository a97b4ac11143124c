"""Connected components by alternating large-star and small-star steps.

Every step is a minimum per node (combined on the map side) and a join of edges with those minima,
so a hub's edges are never gathered in one place and a skewed hub is split by the adaptive join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, ship

ship(__name__)


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (u, v longs): root is the component's least node."""
    now = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(_smallest(both), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        step = large.join(_smallest(large), "u")
        small = step.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(step.select("u", F.col("m").alias("v"))).distinct()
        following = saved(small, "edges")
        discard(now)
        now = following
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
