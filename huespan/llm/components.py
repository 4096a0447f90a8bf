"""Connected components of an edge list, by hooking to the smallest neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huespan.llm.common import drop_materialized, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its component.

    Each round every node takes its smallest neighbour (or itself) as parent, parents are followed to their ends, and the
    edges are rewritten to those ends, which leaves far fewer; a hot node is one row of a partial aggregation. Rounds grow with the
    logarithm of the number of nodes. Every step is written to the shared folder, so no lineage builds up.
    """
    left = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found: DataFrame | None = None
    while not left.isEmpty():
        both = left.select(F.col("b").alias("node"), F.col("a").alias("near")).unionByName(left.select(F.col("a").alias("node"), F.col("b").alias("near")))
        parents = materialize(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("root")), "parents")
        while True:
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = materialize(parents.join(up, "root").select("node", F.col("root").alias("old"), "top"), "jumped")
            drop_materialized(parents)
            parents = jumped.select("node", F.col("top").alias("root"))
            if jumped.where("old <> top").isEmpty():
                break
        a = parents.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = parents.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        rest = materialize(left.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        drop_materialized(left)
        left = rest
        if found is None:
            found = parents
        else:
            further = materialize(_compose(found, parents), "roots")
            drop_materialized(found)
            drop_materialized(parents)
            found = further
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    drop_materialized(left)
    return found


def _compose(found: DataFrame, parents: DataFrame) -> DataFrame:
    """Roots so far, followed one round further."""
    further = parents.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return found.join(further, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
