"""Sinks that a stream can write to again after a stop, without loss and without repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import rules as R
from foliant.operators.catalog import upsert
from foliant.operators.compare import cut


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table under path; an empty one if nothing has been written yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def upsert_partitions(incoming: DataFrame, path: str, partition: str, keys: list[str], order: list[Column | str] | None = None) -> None:
    """Puts incoming rows in place of those of equal keys in the table under path, which is stored by partition; the others of the table stay unread.

    Only partitions that incoming has are read, merged and written anew, each as a whole, so writing the same rows again changes nothing.
    """
    spark = incoming.sparkSession
    incoming = cut(incoming.select(*[c for c in incoming.columns if c != partition], partition))
    touched = incoming.select(partition).distinct()
    old = stored(spark, path, incoming.schema).join(touched, partition, "left_semi").select(incoming.columns)
    merged = cut(upsert(old, incoming, [partition, *keys], order))  # read before its folders are written
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def upsert_batches(path: str, partition: str, keys: list[str], order: list[Column | str] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for upsert_partitions: a batch that is written twice leaves what it left the first time."""

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_partitions(batch, path, partition, keys, order)

    return write


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends: each batch has a folder of its own, which a repeat of the batch writes over."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def embedding_batches(path: str, dims: int, embed: Callable[[Column, int], Column] = R.stub_embedding) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that stores vectors of chunks (chunk_id, content): rows with an equal content hash are embedded once a batch, chunks stored by earlier batches not again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = "chunk_id long, digest string, embedding array<double>, batch int"
        known = stored(spark, path, schema).filter(F.col("batch") != batch_id).select("chunk_id")
        pending = batch.join(known, "chunk_id", "left_anti").withColumn("digest", F.sha2("content", 256)).dropDuplicates(["chunk_id"])
        vectors = pending.groupBy("digest").agg(F.min("content").alias("content")).select("digest", embed(F.col("content"), dims).alias("embedding"))
        pending.join(vectors, "digest").select("chunk_id", "digest", "embedding").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
