"""Column functions of the engine: vectors, ranking, text, rules. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often it is used, and the expression grows by one value only."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for a zero vector, unequal lengths or an empty vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def rrf(*ranks: Column, k: int = 60) -> Column:
    """Reciprocal rank fusion; a null rank adds nothing."""
    total = F.lit(0.0)
    for rank in ranks:
        total = total + F.coalesce(1.0 / (k + rank), F.lit(0.0))
    return total


def min_max(value: Column, low: Column, high: Column) -> Column:
    return F.when(low == high, 1.0).otherwise((value - low) / (high - low))


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def terms(text: Column) -> Column:
    """Lower-case ASCII words and numbers in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def lexical_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct terms that the text has."""
    q = F.array_distinct(terms(query))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, terms(text))) / F.size(q))


def token_estimate(text: Column) -> Column:
    """The larger of words / 0.75 and characters / 4, rounded up; at least 1, but 0 for an empty text."""
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.greatest(words / 0.75, F.length(text) / 4)))).cast("long")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def diff_normal(text: Column) -> Column:
    """Unix line ends, one space for runs inside a line, at most one blank line, no space around."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    t = F.regexp_replace(t, r"(?U)[\s\x1c-\x1f&&[^\n]]+", " ")
    t = F.regexp_replace(t, " ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Cut after a full stop, exclamation or question mark before white space; blank ones are left out."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def needs_ocr(text: Column, least: int = 25) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", "")) < least


def comparison_severity(change: Column, critical: Column, verdict: Column, proportion: Column) -> Column:
    """MAJOR, MODERATE or MINOR of a section change; verdict: material, stylistic or null."""
    return (
        F.when(critical, "MAJOR").when(change.isin("ADDED", "REMOVED"), "MODERATE")
        .when(verdict == "material", F.when(proportion >= 0.3, "MAJOR").otherwise("MODERATE")).when(verdict == "stylistic", "MINOR")
        .when(proportion >= 0.5, "MODERATE").otherwise("MINOR")
    )


def conflict_severity(statements: Column, confidence: Column, critical: Column) -> Column:
    return (
        F.when(critical, "MAJOR").when(statements >= 3, F.when(confidence >= 0.75, "MAJOR").otherwise("MODERATE"))
        .when(confidence >= 0.85, "MODERATE").otherwise("MINOR")
    )


def critical_section(label: Column, patterns: list[str]) -> Column:
    """Whether any pattern is in the label, whatever the case; no pattern: false."""
    return F.exists(F.array(*[F.lit(p.lower()) for p in patterns]), lambda p: F.contains(F.lower(label), p)) if patterns else F.lit(False)


def version_state(effective: Column, current: Column, today: Column) -> Column:
    return F.when(current, "CURRENT").when(effective > today, "SCHEDULED").otherwise("SUPERSEDED")


def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.lit(300.0), 5 * F.pow(F.lit(2.0), attempts - 1)).cast("long")


def citation_markers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(?:SOURCE\s*)?(\d{1,2})\]"), 1), lambda x: x.cast("int"))


#: What a control line of the prompt begins with, and the warning put before such a line of a source.
CONTROL_LINE, CONTROL_WARNING = r'(?im)^([^\S\n]*)(SOURCE[^\S\n]+\d|Document:|Page:|Section:|""")', "WARNING[REDACTED CONTROL TOKEN] "


def redact_controls(text: Column) -> Column:
    """Puts a warning before lines that look like the prompt's own control lines."""
    return F.regexp_replace(text, CONTROL_LINE, CONTROL_WARNING + "$1$2")


def first_line_title(text: Column, most: int = 60) -> Column:
    line = F.trim(F.substring_index(F.ltrim(text), "\n", 1))
    return F.when(F.length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most - 1)), F.lit("…"))).otherwise(line)


def sniff_type(content: Column) -> Column:
    """A file's type by its first bytes, null if unknown."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("25504446"), "application/pdf").when(head.startswith("504B0304"), "application/zip").when(head.startswith("D0CF11E0"), "application/msword")


def wants_rewrite(text: Column, turns: Column) -> Column:
    """A follow-up question: there is history, and it is short or refers back."""
    short = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) <= 12
    return (turns > 0) & (short | F.lower(text).rlike(r"\b(it|this|that|those|these|they|them|above|previous)\b"))
