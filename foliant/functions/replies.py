"""Checks of a model's JSON replies, as variants: kinds, clamps, defaults and lists of items; whatever does not hold falls back field by field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import rules as R
from foliant.functions.expressions import let

#: Intents of a question, items of an extraction, lists of a summary, and the longest reason, topics, rationale and list of hints.
INTENTS = ["QUESTION", "COMPARISON", "CHANGE_DETECTION", "SUMMARY", "CONFLICT_DETECTION", "EXTRACTION"]
SUMMARY_LISTS = ["key_points", "dates", "roles", "requirements", "risks", "topics"]
REASON, CONFLICT_TOPIC, TOPIC, RATIONALE, HINTS = 300, 80, 60, 200, 10


def json_text(raw: Column) -> Column:
    """The reply without a fence and from its first to its last brace, if it has both."""

    def unfenced(bare: Column) -> Column:
        inner = F.regexp_extract(bare, r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1)
        return F.when(bare.rlike(r"(?s)^```(?:json)?\s*(.*?)\s*```$"), R.strip(inner)).otherwise(bare)

    def braced(text: Column) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), text)

    return let(let(R.strip(F.coalesce(raw, F.lit(""))), unfenced), braced)


def reply(raw: Column) -> Column:
    """The reply's object as a variant, null if it holds none."""
    return let(F.try_parse_json(json_text(raw)), lambda parsed: F.when(F.schema_of_variant(parsed).startswith("OBJECT<"), parsed))


def field(v: Column, name: str, kind: str) -> Column:
    """A field of the given kind: text, number, integer, boolean or list; null if it is of another."""
    is_a = {"text": "^STRING$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "integer": "^(BIGINT|DECIMAL\\(\\d+,0\\))$", "boolean": "^BOOLEAN$", "list": "^ARRAY<"}[kind]
    to = {"text": "string", "number": "double", "integer": "long", "boolean": "boolean", "list": "array<variant>"}[kind]
    return let(F.try_variant_get(v, f"$.{name}", "variant"), lambda part: F.when(F.schema_of_variant(part).rlike(is_a), F.try_variant_get(part, "$", to)))


def short(v: Column, name: str, most: int) -> Column:
    """A text field without white space around it, cut to `most` characters; null if there is nothing in it."""
    return F.nullif(F.substring(R.strip(field(v, name, "text")), 1, most), F.lit(""))


def texts(v: Column, name: str, most: int | None = None) -> Column:
    """The text items of a list field that hold something, at most `most`; empty if it is no list."""
    items = F.filter(field(v, name, "list"), lambda x: F.schema_of_variant(x) == "STRING")
    kept = F.filter(F.transform(items, lambda x: R.strip(F.try_variant_get(x, "$", "string"))), lambda s: s != "")
    return F.coalesce(kept if most is None else F.slice(kept, 1, most), F.array().cast("array<string>"))


def conflict_reply(raw: Column) -> Column:
    """is_conflict, confidence (clamped to 0 and 1), reason and topic; null if one of the first two is missing or of another kind."""
    v = reply(raw)
    verdict, confidence = field(v, "is_conflict", "boolean"), field(v, "confidence", "number")
    found = F.struct(verdict.alias("is_conflict"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"), short(v, "reason", REASON).alias("reason"), short(v, "conflict_topic", CONFLICT_TOPIC).alias("topic"))
    return F.when(verdict.isNotNull() & confidence.isNotNull(), found)


def materiality_reply(raw: Column) -> Column:
    """materiality and rationale; null unless the change is called material or stylistic."""
    v = reply(raw)
    word = field(v, "materiality", "text")
    return F.when(word.isin("material", "stylistic"), F.struct(word.alias("materiality"), short(v, "rationale", RATIONALE).alias("rationale")))


def entailment_reply(raw: Column) -> Column:
    """yes, no or partial, whatever the case; null for anything else."""
    word = F.lower(R.strip(field(reply(raw), "verdict", "text")))
    return F.when(word.isin("yes", "no", "partial"), word)


def point_in_time(v: Column, name: str) -> Column:
    """year, of a whole number or a text of digits, else relative, in lower case; null for anything else."""
    digits = field(v, f"{name}.year", "text")
    year = F.coalesce(field(v, f"{name}.year", "integer"), F.when(digits.rlike(r"^\d+$"), digits.cast("long")))
    relative = F.nullif(F.lower(R.strip(field(v, f"{name}.relative", "text"))), F.lit(""))
    return F.when(year.isNotNull() | relative.isNotNull(), F.struct(year.alias("year"), F.when(year.isNull(), relative).alias("relative")))


def analysis_reply(raw: Column) -> Column:
    """intent, scope (see point_in_time), scope_secondary, hints and topic of a question; a plain QUESTION if the reply is no object or names an unknown intent."""
    v = reply(raw)
    named = F.try_variant_get(v, "$.intent", "variant")
    word = F.upper(F.when(v.isNotNull() & named.isNull(), "QUESTION").otherwise(field(v, "intent", "text")))
    time = "struct<year:long,relative:string>"
    found = F.struct(
        word.alias("intent"), point_in_time(v, "temporal_scope").alias("scope"), point_in_time(v, "temporal_scope_secondary").alias("scope_secondary"),
        texts(v, "scope_hints", HINTS).alias("hints"), short(v, "topic", TOPIC).alias("topic"), F.lit(True).alias("understood"),
    )
    none = F.struct(F.lit(INTENTS[0]).alias("intent"), F.lit(None).cast(time).alias("scope"), F.lit(None).cast(time).alias("scope_secondary"), F.array().cast("array<string>").alias("hints"), F.lit(None).cast("string").alias("topic"), F.lit(False).alias("understood"))
    return F.when(word.isin(*INTENTS), found).otherwise(none)


def extraction_reply(raw: Column, most: int) -> Column:
    """Items of each category, at most `most`; null if the reply is no object."""
    return let(reply(raw), lambda v: F.when(v.isNotNull(), F.struct(*[texts(v, c, most).alias(c) for c in R.CATEGORIES])))


def summary_reply(raw: Column) -> Column:
    """executive_summary, empty if it is no text, and the lists; null if the reply is no object."""

    def found(v: Column) -> Column:
        executive = F.coalesce(R.strip(field(v, "executive_summary", "text")), F.lit(""))
        return F.when(v.isNotNull(), F.struct(executive.alias("executive_summary"), *[texts(v, c).alias(c) for c in SUMMARY_LISTS]))

    return let(reply(raw), found)
