"""Connected components by alternating large-star and small-star steps.

Each step keeps at most as many edges as it reads and halves the depth of the trees, so the number of
rounds is logarithmic in the longest chain. No node's neighbours are ever collected in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import settle


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of any orderable type to (node, root): root is the least node of its component.

    Nodes without an edge aren't listed; self loops, repeated and reversed edges are harmless, and
    edges with a null end are ignored. No edges give no rows.
    """
    return joined(edges)[0]


def joined(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Like components, and with it (node, n_links): to how many others each node has an edge."""
    ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), (F.col("u") == F.col("v")).alias("loop"))
    edges = settle(ends.filter(~F.col("loop")).select("u", "v").distinct())
    links = edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    before = _fingerprint(edges)
    per_u = Window.partitionBy("u")
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least(F.min("v").over(per_u), F.col("u"))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.withColumn("m", F.min("v").over(per_u))
        small = least.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = settle(small.filter("u <> v").distinct())
        now = _fingerprint(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), links
