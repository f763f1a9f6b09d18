"""Job states: transitions, retries, sweeps, rate limits, change feeds and purges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import expressions as X

# The transitions a job may make.
TRANSITIONS = {"PENDING": ["PROCESSING", "FAILED"], "PROCESSING": ["COMPLETED", "RETRYING", "FAILED"], "RETRYING": ["PROCESSING", "FAILED"]}


def allowed(source: str, target: str):
    """A column: whether the transition between the two state columns is one of the table's; final states allow none."""
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in TRANSITIONS.items() for x in pair])
    return F.coalesce(F.array_contains(table[F.col(source)], F.col(target)), F.lit(False))


def retry_decisions(jobs: DataFrame) -> DataFrame:
    """Adds next_status and delay to failed attempts (attempts, max_attempts, deterministic)."""
    last = F.col("deterministic") | (F.col("attempts") >= F.col("max_attempts"))
    return jobs.withColumn("next_status", F.when(last, "FAILED").otherwise("RETRYING")).withColumn("delay", F.when(~last, X.backoff_seconds(F.col("attempts"))))


def sweep(jobs: DataFrame, now: str, *, waiting: int = 120, stuck: int = 600, limit: int = 200) -> DataFrame:
    """The oldest jobs that wait or run for too long."""
    age = F.timestamp_diff("SECOND", F.col("updated_at"), F.lit(now).cast("timestamp_ntz"))
    late = (F.col("status").isin("PENDING", "RETRYING") & (age > waiting)) | ((F.col("status") == "PROCESSING") & (age > stuck))
    return jobs.filter(late).orderBy("updated_at", "id").limit(limit)


def change_feed(states: DataFrame, *, key: str, time: str, status: str, tie: str) -> DataFrame:
    """The first state of each key and then only states that differ from the one before."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(time, tie))
    return states.withColumn("previous", before).filter(F.col("previous").isNull() | (F.col("previous") != F.col(status)))


def rate_limited(calls: DataFrame, *, key: str, time: str, seconds: int = 60, most: int = 20) -> DataFrame:
    """Adds how many calls the key made in the window that ends with the call, itself included, and whether that is too many."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    window = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return calls.withColumn("in_window", F.count("*").over(window)).withColumn("limited", F.col("in_window") > most)


def purge_candidates(documents: DataFrame, versions: DataFrame, now: str, *, days: int = 90, limit: int = 50) -> DataFrame:
    """The documents deleted longest ago, out of the retention window, with their number of versions (0 if none) and, if versions have a column key, their keys in order."""
    old = documents.filter(F.col("deleted_at") <= F.lit(now).cast("timestamp_ntz") - F.expr(f"make_dt_interval({days})")).orderBy("deleted_at", "id").limit(limit)
    keyed = [F.array_sort(F.collect_list("key")).alias("keys")] if "key" in versions.columns else []
    own = versions.withColumnRenamed("document_id", "id").join(F.broadcast(old.select("id")), "id", "left_semi")  # at most `limit` rows
    counts = own.groupBy("id").agg(F.count("*").alias("versions"), *keyed)
    out = old.join(counts, "id", "left").withColumn("versions", F.coalesce("versions", F.lit(0)))
    return out.withColumn("keys", F.coalesce("keys", F.array().cast("array<string>"))) if keyed else out


def failure_runs(calls: DataFrame, *, key: str, order: str, failed: str, least: int = 5) -> DataFrame:
    """Runs of at least so many failures in a row: key, first and last order, length."""
    w = Window.partitionBy(key).orderBy(order)
    island = F.sum((~F.col(failed)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = calls.withColumn("_island", island).filter(failed).groupBy(key, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("failures"))
    return runs.filter(F.col("failures") >= least).drop("_island")
