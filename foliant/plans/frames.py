"""Frames of the events of a user, cut into chunks and read back."""

from pyspark.sql import functions as F

from foliant.operators import assembly
from foliant.plans.registry import query, table
from foliant.sources import frames as S


@query("SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 2 - 1 AS INT) AS place, 'status' AS event, event_id, event_type FROM events")
def parsed_frames(spark, sf_dir):
    """A frame for each event with a comment between two, sent in chunks of 41 bytes."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    sent = assembly.frames(rows, "status", ["user_id", "event_id", "event_type"]).select("user_id", "event_id", F.concat(F.lit(": ping\n\n"), "frame").alias("frame"))
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "frame")))
    whole = sent.groupBy("user_id").agg(F.encode(F.array_join(F.transform(ordered, lambda x: x["frame"]), ""), "UTF-8").alias("whole"))
    cut = whole.select("user_id", "whole", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("whole") - 1) / 41).cast("int"))).alias("chunk_no"))
    chunks = cut.select("user_id", "chunk_no", F.substring("whole", F.col("chunk_no") * 41 + 1, F.lit(41)).alias("data"))
    found = S.frames_of_chunks(chunks, "user_id")
    return found.select("user_id", "place", "event", F.variant_get("data", "$.event_id", "long").alias("event_id"), F.variant_get("data", "$.event_type", "string").alias("event_type"))
