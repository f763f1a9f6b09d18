"""Context packing, citations, claims and sampling for generated answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import expressions as X


def drop_contained(sources: DataFrame, group: str) -> DataFrame:
    """group and kept: the sources (source_id, score, text) best first, without blank ones and those equal to, inside or around a kept one; ties by source_id.

    Each source is compared with those kept so far, so groups are to be what a search returns; a cut to the best is the search's.
    """
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "source_id", F.lower(X.collapse(F.coalesce("text", F.lit("")))).alias("t"))))
    grouped = sources.groupBy(group).agg(rows.alias("rows"))
    start = F.filter("rows", lambda x: F.lit(False))

    def step(kept, x):
        twin = F.exists(kept, lambda y: F.contains(y["t"], x["t"]) | F.contains(x["t"], y["t"]))
        return F.when((x["t"] == "") | twin, kept).otherwise(F.concat(kept, F.array(x)))

    return grouped.select(group, F.transform(F.aggregate("rows", start, step), lambda x: x["source_id"]).alias("kept"))


def pack_budget(sources: DataFrame, group: str, budget: int) -> DataFrame:
    """group, used, chosen: in rank order each source (rank, source_id, cost) that still fits is taken; those that do not are passed over."""
    grouped = sources.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", "source_id", F.col("cost").cast("long").alias("cost")))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("chosen"))

    def step(s, x):
        fits = s["used"] + x["cost"] <= budget
        return F.struct(F.when(fits, s["used"] + x["cost"]).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["chosen"], F.array(x["source_id"].cast("long")))).otherwise(s["chosen"]).alias("chosen"))

    packed = F.aggregate("rows", start, step)
    return grouped.select(group, packed["used"].alias("used"), packed["chosen"].alias("chosen"))


def resolve_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """message_id, citation_index, source_id and place of each distinct marker in the answer's text that names a source."""
    marks = answers.select("message_id", F.posexplode(F.array_distinct(X.citation_markers(F.col("text")))).alias("place", "citation_index"))
    return marks.join(sources, ["message_id", "citation_index"])


def median_pick(chunks: DataFrame, section: str, order: str, take: int) -> DataFrame:
    """The middle `take` chunks of each section."""
    w = Window.partitionBy(section)
    n = F.count("*").over(w)
    start = F.floor((n - F.least(n, F.lit(take))) / 2)
    at = F.row_number().over(w.orderBy(order)) - 1
    return chunks.withColumn("_at", at).withColumn("_start", start).filter((F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_start") + take)).drop("_at", "_start")
