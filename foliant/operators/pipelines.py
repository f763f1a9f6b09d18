"""Extraction and summary as whole pipelines: evidence, context, the model's reply, claims, and the rows or text that are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import replies as P
from foliant.functions import rules as R
from foliant.operators import claims as C
from foliant.operators import search as S
from foliant.operators.compare import stored
from foliant.operators.conflicts import merge_pairs

#: Sections of a narrated summary with their headings and what stands for an empty one.
SECTIONS = [
    ("key_points", "Key points", "No key points identified in this document."), ("dates", "Dates", "No dates identified in this document."), ("roles", "Roles", "No roles identified in this document."),
    ("requirements", "Requirements", "No requirements identified in this document."), ("risks", "Risks", "No risks identified in this document."),
]


def category_evidence(chunks: DataFrame, queries: dict[str, list[float]], k: int = 8, *, key: str = "chunk_id") -> DataFrame:
    """key, similarity (the best) and place of the k chunks (key, embedding) nearest to each category's vector; each chunk once, in the order in which the categories found it."""
    found = None
    for at, vector in enumerate(queries.values()):
        part = S.semantic_topk(chunks, vector, k, key=key).select(key, "score", F.lit(at).alias("at"), "rank")
        found = part if found is None else found.unionByName(part)
    best = found.groupBy(key).agg(F.max("score").alias("similarity"), F.min(F.struct("at", "rank")).alias("first"))
    return best.withColumn("place", F.row_number().over(Window.orderBy("first"))).select(key, "similarity", "place")  # at most k rows a category


def flattened(replies: DataFrame, reply: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """The items of a reply's lists (message_id, item_id, category, item_index, text), and the answer they make line by line (message_id, text).

    The lists are stored once, so that a reply is not parsed again for what reads them. A reply that is null has no items and an empty answer.
    """

    def listed(rank: int, name: str) -> Column:
        return F.transform(F.col(f"{reply}.{name}"), lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("item_index"), F.lit(name).alias("category"), x.alias("text")))

    every = F.array_sort(F.flatten(F.array_compact(F.array(*[listed(n, f) for n, f in enumerate(fields)]))))
    rows = stored(replies.select("message_id", F.filter(every, lambda x: R.strip(x["text"]) != "").alias("_items")))
    items = rows.select("message_id", F.posexplode("_items").alias("item_id", "_i")).select("message_id", "item_id", "_i.category", "_i.item_index", "_i.text")
    return items, rows.select("message_id", F.array_join(F.transform("_items", lambda x: x["text"]), "\n").alias("text"))


def extracted_items(replies: DataFrame, sources: DataFrame, verdicts: DataFrame, *, most: int = 30) -> DataFrame:
    """message_id, category, item_index, label, citation_index and quoted text of the items of a model's reply that stand and are cited.

    replies: message_id, raw (the reply); sources: message_id, citation_index, content; verdicts: message_id, claim_no, citation_index, verdict. The lists of the reply become
    one answer; its claims are checked against the sources, and an item keeps the first citation of its claim. Indexes count anew in
    each category. A reply that is no object gives nothing. Sources are read for the citations of kept items alone, each once.
    """
    parsed = replies.select("message_id", P.extraction_reply(F.col("raw"), most).alias("reply"))
    items, answer = flattened(parsed, "reply", R.CATEGORIES)
    numbers = stored(sources.select("message_id", "citation_index"))
    judged = C.validated(stored(C.claims_of(C.cleaned_answers(answer, numbers))), verdicts)
    placed = stored(C.places(judged, numbers))
    kept = C.item_sources(items, judged, placed).join(items.select("message_id", "item_id", "category"), ["message_id", "item_id"])
    told = C.quoted(kept.join(placed, ["message_id", "place"]), sources)
    index = F.row_number().over(Window.partitionBy("message_id", "category").orderBy("item_id")) - 1
    return told.select("message_id", "category", index.alias("item_index"), "label", "citation_index", F.col("quote.text").alias("quoted"))


def narrated_summary(summaries: DataFrame, summary: str) -> DataFrame:
    """Adds text: a summary's fields (executive_summary and lists of texts) as paragraphs with headings; an empty field says so."""

    def items(name: str) -> Column:
        return F.filter(F.transform(F.coalesce(F.col(f"{summary}.{name}"), F.array().cast("array<string>")), R.strip), lambda x: x != "")

    def section(name: str, heading: str, empty: str) -> Column:
        body = F.when(F.size(items(name)) > 0, F.transform(items(name), lambda x: F.concat(F.lit("- "), x))).otherwise(F.array(F.lit(f"_{empty}_")))
        return F.concat(F.array(F.lit(""), F.lit(f"**{heading}:**")), body)

    executive = R.strip(F.coalesce(F.col(f"{summary}.executive_summary"), F.lit("")))
    first = F.array(F.when(executive == "", "_The document produced no executive summary._").otherwise(executive))
    topics = F.when(F.size(items("topics")) > 0, F.array(F.lit(""), F.concat(F.lit("**Topics:** "), F.array_join(items("topics"), ", ")))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(first, *[section(*s) for s in SECTIONS], topics), "\n")
    return summaries.withColumn("text", F.when(F.col(summary).isNull(), "The summary for this document is not available yet.").otherwise(R.strip(text)))


def seeded_merge(changes: DataFrame, seeds: DataFrame, members: DataFrame) -> DataFrame:
    """What the seeds among a comparison's changes (change_id, a_chunk, b_chunk; see library.seeded_conflicts) do to the conflicts, taken in order of change_id: see conflicts.merge_pairs."""
    pairs = changes.join(seeds, "change_id").select(F.col("change_id").alias("seq"), F.col("a_chunk").alias("a"), F.col("b_chunk").alias("b"), "topic")
    return merge_pairs(pairs, members)
