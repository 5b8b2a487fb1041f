"""Connected components by alternating large and small stars, as joins of narrow tables.

Every round is written out, so a lost executor costs one round's tasks, and a hot centre's rows meet its minimum in a
join of two scans, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixsieve.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): for each node of edges (a, b) the smallest node reachable; roots themselves are left out."""
    scratch = Scratch(scratch.spark, "components")
    now = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges0")
    seen, step = None, 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = scratch.save(least.select("u", F.least("u", "m").alias("m")), f"large-min{step}")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"large{step}")
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"small-min{step}")
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"edges{step + 1}")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"edges{step}", f"large-min{step}", f"large{step}", f"small-min{step}")
        now, step = new, step + 1
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
