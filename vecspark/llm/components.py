"""Connected components of a graph given by its edges, by alternating large and small stars.

Each round is two joins on a vertex's smallest neighbour and is written to the shared folder; the number of rounds grows
with the logarithm of the largest component. No vertex's neighbours are gathered in one row or task: minima are combined
before the shuffle, and the join with them can be split where a vertex has very many neighbours.

Edges with a null end, or from a vertex to itself, say nothing and are left out; repeated edges count once; without edges
there are no rows. Other columns are not looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node with an edge in ``edges`` (a, b: integers): root is the smallest node of its component."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("sum")).first()
        if state == before or not state.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
        before = state
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = stored(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", "m"))
        now = stored(small.distinct(), "small-star")
