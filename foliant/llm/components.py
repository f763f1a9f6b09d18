"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from foliant.llm.common import discard, stash


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b), both long: component is the smallest id that links reach.

    Each step is a grouped minimum and a join, so a hub of any degree is dealt out by rows; edges are written to the shared folder after
    each round. Rows with equal or null ends are ignored.
    """
    ends = links.filter(F.col("a") != F.col("b"))
    edges = stash(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while edges.stashed_rows:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        seen = Observation()
        new = small.unionByName(low.withColumnRenamed("m", "v")).filter("u != v").distinct()
        new = stash(new.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        now = seen.get
        discard(edges)
        edges = new
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
