"""Column rules around dates, token budgets, answers and life cycles. All but sentence_spans are built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import expressions as X

#: The states of a version in order, the jobs of the pipeline in order, search modes and item categories.
VERSION_STATES = ["UPLOADED", "PROCESSING", "EXTRACTING", "OCR", "CHUNKING", "EMBEDDING", "INDEXING", "READY"]
PIPELINE_JOBS = ["EXTRACTION", "CHUNKING", "EMBEDDING", "INDEXING"]
SEARCH_MODES = ["hybrid", "semantic", "keyword"]
CATEGORIES = ["requirement", "risk", "date", "party"]

CANARY = r"§CANARY-\w+"


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def storage_key(org: Column, document: Column, version: Column, extension: Column) -> Column:
    """The object key of a version's original file; dots before the extension go."""
    return F.format_string("organizations/%s/documents/%s/versions/%s/original.%s", org, document, version, F.regexp_replace(extension, r"^\.+", ""))


def coerced_date(value: Column) -> Column:
    """The ISO date that a string starts with, or null."""
    head = F.substring(value, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(head, F.lit("yyyy-MM-dd")).cast("date"))


def valid_window(effective: Column, expiration: Column) -> Column:
    """An expiry may not lie before the effective date; a missing date is no fault."""
    return F.coalesce(expiration >= effective, F.lit(True))


def year_end(year: Column) -> Column:
    return F.make_date(year, F.lit(12), F.lit(31))


def known_types(asked: Column, allowed: list[str]) -> Column:
    """The asked types without unknown ones; all of them if none is known, so that such a filter matches nothing."""
    known = F.filter(asked, lambda t: t.isin(*allowed))
    return F.when(F.size(known) == 0, asked).otherwise(known)


def search_mode(mode: Column) -> Column:
    """The asked mode, or the default for unknown and missing ones."""
    return F.when(mode.isin(*SEARCH_MODES), mode).otherwise(SEARCH_MODES[0])


def category_rank(category: Column) -> Column:
    """The fixed order of categories; others last."""
    rank = F.lit(len(CATEGORIES))
    for i, name in enumerate(CATEGORIES):
        rank = F.when(category == name, i).otherwise(rank)
    return rank


def version_step_allowed(before: Column, after: Column) -> Column:
    """Versions go forward only, skipping allowed; all but READY may fail; FAILED goes back to PROCESSING alone."""
    order = F.array(*map(F.lit, VERSION_STATES))
    forward = F.array_position(order, after) > F.array_position(order, before)
    return F.when(before == "FAILED", after == "PROCESSING").when(before == "READY", False).otherwise((after == "FAILED") | forward)


def clip_to_tokens(text: Column, budget: int) -> Column:
    """A text over the budget is cut to 4 characters a token, then halved until it fits, and marked as cut."""
    cut = F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.substring(text, 1, 4 * budget), lambda s, _: F.when(X.token_estimate(s) > budget, F.substring(s, F.lit(1), F.floor(F.length(s) / 2).cast("int"))).otherwise(s))
    return F.when(X.token_estimate(text) <= budget, text).otherwise(F.concat(cut, F.lit(" [...]")))


def keep_words(text: Column, most: int) -> Column:
    """The first words of about `most` tokens, at least one."""
    w = words(text)
    ratio = F.greatest(F.lit(1.0), X.token_estimate(text) / F.greatest(F.size(w), F.lit(1)))
    return F.array_join(F.slice(w, F.lit(1), F.greatest(F.lit(1), F.floor(most / ratio).cast("int"))), " ")


def inert_metadata(value: Column) -> Column:
    """Names on one header line: line ends become a space, null an empty text."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n]+", " ")


def strip_canary(text: Column) -> Column:
    """The text without sentences that hold a canary token; a text without one stays as it is."""
    kept = F.filter(F.transform(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: ~s.rlike(CANARY)), strip), lambda s: s != "")
    return F.when(text.rlike(CANARY), strip(F.array_join(kept, " "))).otherwise(text)


def strip_markers(text: Column, valid: Column) -> Column:
    """The text without citation markers that name no valid source; doubled spaces become one."""
    wrong = F.array_except(X.citation_markers(text), valid)
    cleaned = F.aggregate(wrong, text, lambda t, i: F.regexp_replace(t, F.concat(F.lit(r"\[(?:SOURCE\s*)?0?"), i.cast("string"), F.lit(r"\]")), F.lit("")))
    return F.regexp_replace(cleaned, " {2,}", " ")


#: Where a text is cut into sentences, and the white space that regular expressions of Spark know.
SENTENCE_END, BLANKS = re.compile(r"""[.!?\]](?:(?<=\])\s+|(?<!\])\s+(?=[A-Z0-9"'(]))""", re.ASCII), " \t\n\x0b\f\r"


def spans_of(text: str) -> Iterator[tuple[str, int, int]]:
    """sentence, begin and end of the sentences of a text, in one pass over it."""
    text = text.replace("\x01", " ")
    at = 0
    for stop in [*(m.end() for m in SENTENCE_END.finditer(text)), len(text)]:
        piece = text[at:stop]
        bare = piece.strip(BLANKS)
        if bare:
            begin = at + len(piece) - len(piece.lstrip(BLANKS))
            yield bare, begin, stop if stop == len(text) else begin + len(bare)
        at = stop


def sentence_spans(text: Column) -> Column:
    """(sentence, begin, end) with offsets into the text; cut before a capital, digit, quote or bracket, and after a marker. Blank pieces go."""
    kind = pa.struct([("sentence", pa.string()), ("begin", pa.int32()), ("end", pa.int32())])

    @F.arrow_udf("array<struct<sentence:string,begin:int,end:int>>")
    def spans(texts: pa.Array) -> pa.Array:
        offsets, sentences, begins, ends = [0], [], [], []
        for t in texts:
            for sentence, begin, end in spans_of(t.as_py() or ""):
                sentences.append(sentence)
                begins.append(begin)
                ends.append(end)
            offsets.append(len(sentences))
        rows = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip((sentences, begins, ends), kind)], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows, mask=texts.is_null())

    return spans(text)


def fallback_topic(label_a: Column, label_b: Column) -> Column:
    """A conflict's topic from the section labels of its sides."""
    a, b = F.nullif(label_a, F.lit("")), F.nullif(label_b, F.lit(""))
    both = F.concat(a, F.lit(" / "), b)
    return F.coalesce(F.concat(F.coalesce(both, a, b), F.lit(" disagreement")), F.lit("Cross-document disagreement"))


def stub_embedding(text: Column, dims: int) -> Column:
    """A unit vector that depends on the text alone: a chain of SHA-256, each four bytes a signed number."""

    def numbers(digest):
        def number(i):
            raw = F.conv(F.substr(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("long")
            return F.when(raw >= 1 << 31, raw - (1 << 32)).otherwise(raw) / float(1 << 31)

        return F.transform(F.sequence(F.lit(0), F.lit(7)), number)

    start = F.struct(F.sha2(text, 256).alias("seed"), F.array().cast("array<double>").alias("raw"))

    def step(s, _):
        seed = F.sha2(F.unhex(s["seed"]), 256)
        return F.struct(seed.alias("seed"), F.concat(s["raw"], numbers(seed)).alias("raw"))

    raw = F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(-(-dims // 8))), start, step)["raw"], 1, dims)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def highlighted(text: Column, terms: Column) -> Column:
    """The text with each term, whatever its case, between marks; terms are words."""
    pattern = F.concat(F.lit("(?i)("), F.array_join(terms, "|"), F.lit(")"))
    return F.when(F.size(terms) > 0, F.regexp_replace(text, pattern, F.lit("<mark>$1</mark>"))).otherwise(text)


def json_object(text: Column, schema: str) -> Column:
    """Fields of the outermost braces in a model's reply, fenced or not; null where there is no valid object."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)
