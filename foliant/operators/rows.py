"""Reads and writes of single tables and short texts made of their rows: details, grants, settings, narrations, bulk actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headings of a narrated extraction, severities in order, and the sections of a narrated summary with what stands in an empty one.
HEADINGS = {"requirement": "Requirements", "risk": "Risks", "date": "Dates", "party": "Parties"}
SEVERITIES = ["MAJOR", "MODERATE", "MINOR"]


def snippet(text: Column, most: int) -> Column:
    """The first characters of a text; null stays null."""
    return F.substring(text, 1, most)


def clipped(text: Column, budget: int = 2000) -> Column:
    """(text, cut): a text of more than `budget` tokens, at six characters each, is cut there and marked."""
    long = F.greatest(F.lit(1), F.floor(F.length(text) / 6)) > budget
    return F.struct(F.when(long, F.concat(F.substring(text, 1, 6 * budget), F.lit(" [...]"))).otherwise(text).alias("text"), long.alias("cut"))


def vector_of(text: Column) -> Column:
    """The vector that a stored text of numbers in brackets spells; null for anything else, an empty one for []."""
    inner = F.regexp_extract(F.trim(text), r"^\[(.*)\]$", 1)
    numbers = F.transform(F.split(inner, ","), lambda x: F.trim(x).try_cast("double"))
    fine = F.when(F.trim(inner) == "", F.array().cast("array<double>")).when(F.forall(numbers, lambda x: x.isNotNull()), numbers)
    return F.when(F.trim(text).rlike(r"^\[.*\]$"), fine)


def text_of(vector: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))


def critical_patterns(settings: Column) -> Column:
    """The texts at comparison.critical_sections of a settings object (JSON), blank ones and other kinds left out; none if there is no such list."""
    value = F.try_parse_json(settings)
    part = F.try_variant_get(value, "$.comparison.critical_sections", "variant")
    items = F.when(F.schema_of_variant(part).startswith("ARRAY<"), F.try_variant_get(value, "$.comparison.critical_sections", "array<variant>"))
    texts = F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    return F.coalesce(F.filter(texts, lambda x: F.trim(x) != ""), F.array().cast("array<string>"))


def numbered_by(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Adds place in an order over the whole of a short list."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def granted(grants: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked grants (document_id, user_id, permission) with outcome: created, or conflict where the user holds one of the document already; equal asked pairs are one."""
    pair = ["document_id", "user_id"]
    held = grants.select(*pair).distinct().withColumn("_held", F.lit(True))
    once = asked.groupBy(*pair).agg(F.max("permission").alias("permission"))
    return once.join(held, pair, "left").select(*pair, "permission", F.when(F.col("_held"), "conflict").otherwise("created").alias("outcome"))


def grant_list(grants: DataFrame, users: DataFrame) -> DataFrame:
    """Grants with the grantee's name and their place in the document's list, oldest first, ties by user; unknown users go."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("created_at", "user_id"))
    return grants.join(users, "user_id").withColumn("place", place)


def enriched(citations: DataFrame, versions: DataFrame) -> DataFrame:
    """citations with version_number and effective_date of their version (version_id), null where it is unknown."""
    return citations.join(versions.select("version_id", "version_number", "effective_date"), "version_id", "left")


def listed_by(rows: DataFrame, group: str, order: str, *columns: str) -> DataFrame:
    """group and its rows as one ordered list of the columns; for groups of a bounded size, such as the citations of a message."""
    return rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("rows"))


def done_sections(changes: DataFrame) -> DataFrame:
    """comparison_id and the sections it has changes of, in order of the alphabet."""
    return changes.groupBy("comparison_id").agg(F.array_sort(F.collect_set("section")).alias("sections"))


def ordered_pair(a: Column, b: Column) -> Column:
    """The two sides of a comparison in the order under which it is stored."""
    return F.array_sort(F.array(a, b))


def narrated_changes(changes: DataFrame) -> DataFrame:
    """comparison_id and a plain text of its changes (severity, change, section, order): by severity, each with its section."""
    rows = F.array_sort(F.collect_list(F.struct("order", "severity", "change", F.coalesce("section", F.lit("Unknown section")).alias("section"))))
    grouped = changes.groupBy("comparison_id").agg(rows.alias("_rows"))

    def block(severity: str) -> Column:
        own = F.filter("_rows", lambda r: r["severity"] == severity)
        head = F.concat(F.lit(f"\n{severity} changes ("), F.size(own).cast("string"), F.lit("):"))
        return F.when(F.size(own) > 0, F.concat(F.array(head), F.transform(own, lambda r: F.concat(F.lit("  • ["), r["change"], F.lit("] "), r["section"]))))

    blocks = F.flatten(F.array_compact(F.array(*[block(s) for s in SEVERITIES])))
    return grouped.select("comparison_id", F.array_join(F.concat(F.array(F.lit("Document comparison results:")), blocks), "\n").alias("text"))


def narrated_items(items: DataFrame) -> DataFrame:
    """document_id and a plain text of its extracted items (category, item_index, label): by category in the fixed order."""
    rows = F.array_sort(F.collect_list(F.struct("item_index", "category", "label")))
    grouped = items.groupBy("document_id").agg(rows.alias("_rows"))

    def block(category: str, heading: str) -> Column:
        own = F.filter("_rows", lambda r: r["category"] == category)
        return F.when(F.size(own) > 0, F.concat(F.array(F.lit(""), F.lit(f"**{heading}:**")), F.transform(own, lambda r: F.concat(F.lit("- "), r["label"]))))

    blocks = F.flatten(F.array_compact(F.array(*[block(c, h) for c, h in HEADINGS.items()])))
    return grouped.select("document_id", F.array_join(F.concat(F.array(F.lit("Here is what I found in this document:")), blocks), "\n").alias("text"))


def narrated_conflicts(conflicts: DataFrame, statements: DataFrame) -> DataFrame:
    """group and a plain text of its conflicts (group, conflict_id, severity, topic): by severity, each with the names of its documents and its first four statements.

    statements: conflict_id, place, name, text.
    """
    said = F.struct("place", "name", "text")
    rows = statements.select("conflict_id", "place", F.coalesce("name", F.lit("Unknown document")).alias("name"), F.when(F.col("place") <= 4, snippet(F.coalesce("text", F.lit("")), 200)).alias("text"))
    of = rows.groupBy("conflict_id").agg(F.collect_list(F.when(F.col("place") <= 4, said)).alias("_said"), F.collect_set("name").alias("_names"))
    of = of.select("conflict_id", F.when(F.size("_said") > 0, F.array_sort("_said")).alias("_said"), F.array_join(F.array_sort("_names"), ", ").alias("_names"))
    rows = conflicts.join(of, "conflict_id", "left")
    head = F.concat(F.lit("\n• ["), F.col("severity"), F.lit("] "), F.coalesce("topic", F.lit("Unlabelled conflict")), F.lit(" — conflicting sources: "), F.coalesce("_names", F.lit("")))
    lines = F.transform(F.coalesce("_said", F.filter("_said", lambda s: F.lit(False))), lambda s: F.concat(F.lit("    - "), s["name"], F.lit(': "'), s["text"], F.lit('"')))
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    block = F.array_join(F.concat(F.array(head), F.coalesce(lines, F.array().cast("array<string>"))), "\n")
    told = rows.filter(rank > 0).groupBy("group").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "conflict_id", block.alias("block")))).alias("_blocks"))
    return told.select("group", F.concat(F.lit("I found the following recorded conflicts:\n"), F.array_join(F.transform("_blocks", lambda b: b["block"]), "\n")).alias("text"))


def bulk_rows(documents: DataFrame, asked: DataFrame, action: str, now: Column) -> DataFrame:
    """id, outcome, deleted_at and tag after a bulk action (delete, restore or tag) on asked ids (document_id, tag): each row succeeds or fails by itself.

    missing: there is no such document; unchanged: it is deleted already, or not deleted, or has the tag; done: otherwise.
    """
    once = asked.groupBy(F.col("document_id").alias("id")).agg(F.max("tag").alias("_tag"))
    rows = once.join(documents.select("id", "deleted_at", "tag", F.lit(True).alias("_there")), "id", "left")
    there, gone = F.coalesce("_there", F.lit(False)), F.col("deleted_at").isNotNull()
    fits = {"delete": ~gone, "restore": gone, "tag": ~gone & ~F.col("tag").eqNullSafe(F.col("_tag"))}[action]
    outcome = F.when(~there, "missing").when(fits, "done").otherwise("unchanged")
    after = {"delete": F.when(fits, now).otherwise(F.col("deleted_at")), "restore": F.lit(None).cast("timestamp"), "tag": F.col("deleted_at")}[action]
    tag = F.when(there & fits, F.col("_tag")).otherwise(F.col("tag")) if action == "tag" else F.col("tag")
    return rows.select("id", outcome.alias("outcome"), F.when(there, after).alias("deleted_at"), tag.alias("tag"))
