"""The corpus pipeline: each stage applies one training-data operator to all documents that the stage before kept.

A document without an id passes the near-duplicate stage, as no kept id can name it; of several rows with one id one
stays there. Extra columns of the input, whatever their names, are carried to the last stage, which returns pieces of documents. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import join_counted, stash, unused
from foliant.llm.op1_mixing import mix
from foliant.llm.op6_packing import karmarkar_karp_packing
from foliant.llm.op7_language_id import language_verdict
from foliant.llm.op8_ngram_jaccard import jaccard_components
from foliant.llm.op9_line_dedup import line_dedup


def small_batches(spark: SparkSession) -> None:
    """Rows with texts travel to Python 2000 at a time, unless the session sets another number than Spark's own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "2000")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the rejected go."""
    small_batches(spark)
    labelled = docs.select("doc_id", "text", "lang").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return docs.filter(~language_verdict(labelled)("text")["rejected"])


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that recur across documents."""
    small_batches(spark)
    found = line_dedup(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    return found.select(*[F.col("text") if c.lower() == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each group linked by shingle similarity."""
    small_batches(spark)
    groups = jaccard_components(docs.select("doc_id", "text"))
    name = unused(docs.columns, "_n")
    kept = stash(groups.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias(name)))
    found = join_counted(docs, kept.filter(F.col(name) == 1).select("doc_id"), "doc_id", "left_semi")
    if not kept.filter(F.col(name) > 1).isEmpty():  # rows that share an id: one of each id
        found = found.unionByName(join_counted(docs, kept.filter(F.col(name) > 1).select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return found.unionByName(docs.filter("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, in the order of its shards."""
    return mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    small_batches(spark)
    import public_tokenizers

    return karmarkar_karp_packing(docs, public_tokenizers.path("byte_bpe_50k.json"), lookups=100_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_recurring_lines),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
