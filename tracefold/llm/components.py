"""Connected components of a link table as joins: hook every vertex to its least neighbour, shorten the pointers, contract.

Each round at least halves the vertices that still have links, apart from the least of each neighbourhood, so a few
rounds do. Between rounds the tables are written to the shared folder. Nothing is collected but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import scratch


def _shorten(pointers: DataFrame) -> DataFrame:
    """(v, root): pointers (v, p) with p < v followed to their ends, by doubling."""
    while True:
        onward = pointers.select(F.col("v").alias("p"), F.col("p").alias("next"))
        stepped = scratch(pointers.join(onward, "p", "left").select("v", F.coalesce("next", "p").alias("p"), F.col("next").isNotNull().alias("moved")), "pointers")
        pointers = stepped.select("v", "p")
        if stepped.where("moved").isEmpty():
            return pointers


def components(links: DataFrame) -> DataFrame:
    """(v, component) for every vertex of links (a, b): the least vertex that it reaches. Any orderable type.

    Null ends and loops are left out; repeated links count once; no links give no rows.
    """
    edges = scratch(links.where("a < b or b < a").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "links")
    labels = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("component", F.col("v"))
    while not edges.isEmpty():
        hooks = edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p"))  # each vertex with a lesser neighbour
        roots = _shorten(scratch(hooks, "hooks"))
        root = roots.select(F.col("v").alias("component"), F.col("p").alias("root"))
        labels = scratch(labels.join(root, "component", "left").select("v", F.coalesce("root", "component").alias("component")), "labels")
        a = roots.select(F.col("v").alias("a"), F.col("p").alias("ra"))
        b = roots.select(F.col("v").alias("b"), F.col("p").alias("rb"))
        moved = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        edges = scratch(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return labels
