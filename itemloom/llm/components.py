"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm.workspace import Workspace


def components(links: DataFrame, space: Workspace, name: str = "stars") -> DataFrame:
    """(node, root) for every node of links (a, b); root is the component's smallest node.

    Every step is a join with a partially aggregated minimum, written to the shared folder, so
    that no component is ever gathered into one task: a hub's links are one side of a join whose other side has
    one row for it, which adaptive execution splits.  The result is a table of ``space``, named ``name``.
    """
    both = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = space.save(both, f"{name}-0")
    step, last = 0, None
    while True:
        around = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = space.save(large, f"{name}-{step}-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        step += 1
        now = space.save(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-{step}")
        space.drop(f"{name}-{step - 1}", f"{name}-{step - 1}-large")
        space.tidy()  # small as a step's shuffles are, they have a file or more a task
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    roots = now.groupBy("a").agg(F.min("b").alias("root"))
    roots = roots.select(F.col("a").alias("node"), "root").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    roots = space.save(roots, name)
    space.drop(f"{name}-{step}")
    return roots
