"""Connected components of a link table, by alternating star contraction.

Each round joins every node with the smallest node it is linked to; after a
few rounds all links point to the smallest node of their component.  Nodes
with very many links are met only by partial minima and by joins whose large
side Spark may split.  Each round is written to the shared folder, so a lost
executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jisfold.llm.common import discard, stash


def _point_to_minimum(links: DataFrame, larger_only: bool) -> DataFrame:
    """One star step.  links: (a, b), b < a.

    larger_only: each node sends the least of its neighbours and itself to its
    larger neighbours; otherwise to its smaller ones and itself.
    """
    if larger_only:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        # a link (a, b): its larger end a hears from b
        return links.join(least, links.b == least.n).select(F.col("a"), F.col("m").alias("b"))
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    found = links.join(least.withColumnRenamed("a", "n"), F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return found.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node; component is its least node.

    links: columns a and b of one orderable type.  Links to itself, repeated
    links and links with a null end are ignored; an empty table gives none.
    """
    links = (
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    now, before = stash(links, "links"), None
    while True:
        step = _point_to_minimum(now, True).where("a != b").distinct()
        step = _point_to_minimum(step, False).where("a != b").distinct()
        after = stash(step, "links")
        state = after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if state == before or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = state
