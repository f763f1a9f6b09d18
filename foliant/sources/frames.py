"""Server-sent frames read back: from stored streams, and from chunks that cut frames anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def frame_event(block: Column) -> Column:
    """The event's name in a block, null if it names none."""
    lines = F.filter(F.split(F.trim(block), "\n"), lambda x: F.startswith(x, F.lit("event:")))
    return F.nullif(F.trim(F.substring(F.element_at(F.when(F.size(lines) > 0, lines), -1), 7, 1 << 30)), F.lit(""))


def frame_data(block: Column) -> Column:
    """The lines of data in a block, joined; null if there is none."""
    lines = F.filter(F.split(F.trim(block), "\n"), lambda x: F.startswith(x, F.lit("data:")))
    return F.when(F.size(lines) > 0, F.array_join(F.transform(lines, lambda x: F.trim(F.substring(x, 6, 1 << 30))), "\n"))


def parsed_frames(blocks: DataFrame, block: str = "block") -> DataFrame:
    """Adds event and data (a variant object; empty without data lines). Comments, blocks without a name and those whose data is no JSON go."""
    rows = blocks.withColumns({"event": frame_event(F.col(block)), "_data": F.coalesce(frame_data(F.col(block)), F.lit("{}"))}).withColumn("data", F.try_parse_json("_data"))
    return rows.filter("event IS NOT NULL AND data IS NOT NULL").drop(block, "_data")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """path, event and data of all frames of the files under path. Files are split between tasks; Spark's reader joins a frame that lies across a split."""
    blocks = spark.read.option("lineSep", "\n\n").option("recursiveFileLookup", "true").text(path)
    return parsed_frames(blocks.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("block")))


def frames_of_chunks(chunks: DataFrame, stream: str = "stream") -> DataFrame:
    """stream, place, event and data of streams that came in chunks (stream, chunk_no, data: bytes), wherever a chunk ends, inside a character too.

    The chunks of a stream, which is one connection, are put together before they are cut at blank lines; a last frame may lack its end.
    """
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", F.hex("data").alias("hex"))))
    whole = F.make_valid_utf8(F.unhex(F.array_join(F.transform(ordered, lambda c: c["hex"]), "")).cast("string"))
    blocks = chunks.groupBy(stream).agg(whole.alias("whole")).select(stream, F.posexplode(F.split("whole", "\n\n")).alias("place", "block"))
    return parsed_frames(blocks)
