"""Joins and row rules around retrieval, comparison, conflicts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def section_label(number: Column, title: Column) -> Column:
    """Number and title with a space between, or the one there is, or null."""
    parts = F.array_compact(F.array(F.nullif(number, F.lit("")), F.nullif(title, F.lit(""))))
    return F.when(F.size(parts) > 0, F.array_join(parts, " "))


def retrieval_rows(chunks: DataFrame, versions: DataFrame, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks with their version, document and section label; a chunk without a section stays.

    chunks: chunk_id, version_id, section_id; versions: version_id, document_id; documents: document_id, name; sections: section_id, number, title.
    """
    labels = sections.select("section_id", section_label(F.col("number"), F.col("title")).alias("label"))
    return chunks.join(versions, "version_id").join(documents, "document_id").join(labels, "section_id", "left")


#: Rows of both sides that one task of a join by chunk takes.
ROWS_OF_PART = 1 << 20


def shared_conflicts(retrieved: DataFrame, statements: DataFrame) -> DataFrame:
    """query, conflict_id and n of conflicts of which at least two retrieved chunks (query, chunk_id) are statements.

    Repeated rows go where their chunk lies, before the join, so what meets is counted once each without a table of all chunks of a task. Chunks are dealt
    into parts of about ROWS_OF_PART rows, so a task's memory does not grow with the tables.
    """
    spark = retrieved.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, (retrieved.count() + statements.count()) // ROWS_OF_PART + 1)
    asked = retrieved.select("query", "chunk_id").repartition(parts, "chunk_id").distinct()
    held = statements.select("conflict_id", "chunk_id").repartition(parts, "chunk_id").distinct()
    met = asked.join(held, "chunk_id").groupBy("query", "conflict_id").agg(F.count("*").alias("n"))
    return met.filter("n >= 2")


def exact_pairs(candidates: DataFrame, statements: DataFrame) -> DataFrame:
    """a, b and the first conflict of candidate pairs that are both statements of one conflict already."""
    of = statements.select("conflict_id", "chunk_id")
    left = candidates.join(of.withColumnRenamed("chunk_id", "a"), "a")
    both = left.join(of.select("conflict_id", F.col("chunk_id").alias("b")), ["conflict_id", "b"])
    return both.groupBy("a", "b").agg(F.min("conflict_id").alias("conflict_id"))


def best_per_chunk(hits: DataFrame) -> DataFrame:
    """chunk_id, its best similarity and where it was first seen, of hits (chunk_id, similarity, seen) of several queries."""
    return hits.groupBy("chunk_id").agg(F.max("similarity").alias("similarity"), F.min("seen").alias("first_seen"))


def upper_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group and the element in the upper middle of its sorted values; ranks instead of a list, so a large group stays distributed in memory."""
    w = Window.partitionBy(group)
    ranked = rows.filter(F.col(value).isNotNull()).select(group, value, F.row_number().over(w.orderBy(value)).alias("_at"), F.count("*").over(w).alias("_n"))
    return ranked.filter(F.col("_at") == F.floor(F.col("_n") / 2) + 1).select(group, F.col(value).alias("median"))


def even_sample(rows: DataFrame, group: str, order: str, target: int) -> DataFrame:
    """`target` rows of each group at even steps in reading order; all rows of a smaller group."""
    w = Window.partitionBy(group)
    at, n = F.row_number().over(w.orderBy(order)) - 1, F.count("*").over(w)
    placed = rows.withColumn("_at", at).withColumn("_n", n)
    # position p is taken if it is int(i * n / target) of an i: the first i with i * n / target >= p gives it
    i = F.ceil(F.col("_at") * target / F.col("_n"))
    taken = (F.col("_n") <= target) | ((i < target) & (F.floor(i * F.col("_n") / target) == F.col("_at")))
    return placed.filter(taken).drop("_at", "_n")


def positional_relevance(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Adds relevance, which falls by 0.00005 a place and never under 0.5."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return rows.withColumn("relevance", F.round(F.greatest(F.lit(0.5), 1 - at * 0.00005), 6))


def claim_of_marker(markers: DataFrame, sentences: DataFrame) -> DataFrame:
    """message_id, place and claim: the first sentence (message_id, claim, begin, end) whose span, both ends included, holds the marker's place."""
    inside = markers.join(sentences, "message_id").filter(F.col("place").between(F.col("begin"), F.col("end")))
    return inside.groupBy("message_id", "place").agg(F.min_by("claim", "begin").alias("claim"))


def job_progress(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, status, progress: the active job's, else the latest one's; READY documents are at 100.

    jobs: document_id, job_id, status, progress, at; documents: document_id, status.
    """
    active = F.col("status").isin("PENDING", "PROCESSING", "RETRYING")
    order = Window.partitionBy("document_id").orderBy(active.desc(), F.desc("at"), F.desc("job_id"))
    latest = jobs.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("document_id", F.col("status").alias("job_status"), "progress")
    joined = documents.join(latest, "document_id", "left")
    clamped = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("progress", F.lit(0))))
    return joined.select("document_id", F.coalesce("job_status", "status").alias("status"), F.when(F.col("status") == "READY", 100).otherwise(clamped).alias("progress"))


def retryable(jobs: DataFrame) -> DataFrame:
    """The latest failed job of each document (document_id, job_id, status, at) without a job under way."""
    order = Window.partitionBy("document_id").orderBy(F.desc("at"), F.desc("job_id"))
    failed = jobs.filter("status = 'FAILED'").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return failed.join(jobs.filter(F.col("status").isin("PENDING", "PROCESSING", "RETRYING")).select("document_id").distinct(), "document_id", "left_anti")


def scan_due(orgs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Organisations (org) with no conflict scan (org, status) in flight."""
    return orgs.join(jobs.filter(F.col("status").isin("PENDING", "PROCESSING", "RETRYING")).select("org"), "org", "left_anti")


def stale_summaries(summaries: DataFrame, chunked: DataFrame) -> DataFrame:
    """summaries (version_id, summarized_at) with stale: chunks of the version (version_id, chunked_at) are newer."""
    last = chunked.groupBy("version_id").agg(F.max("chunked_at").alias("_last"))
    joined = summaries.join(last, "version_id", "left")
    return joined.withColumn("stale", F.coalesce(F.col("_last") > F.col("summarized_at"), F.lit(False))).drop("_last")


def resumed(rows: DataFrame, key: str, cursor: int | None) -> DataFrame:
    """What is left to do after the cursor, in order of the key."""
    return (rows if cursor is None else rows.filter(F.col(key) > cursor)).orderBy(key)


def bulk_outcomes(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """outcome and n of a bulk deletion of asked ids: done, or failed where the document is missing or deleted already."""
    live = documents.filter("deleted_at IS NULL").select(F.col("id").alias("document_id"), F.lit(True).alias("_live"))
    outcome = F.when(F.col("_live"), "succeeded").otherwise("failed")
    return asked.join(live, "document_id", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def frames(changes: DataFrame, event: str, columns: list[str]) -> DataFrame:
    """One server-sent frame for each row: the event's name and the columns as JSON."""
    return changes.select(*columns, F.concat(F.lit(f"event: {event}\ndata: "), F.to_json(F.struct(*columns)), F.lit("\n\n")).alias("frame"))
