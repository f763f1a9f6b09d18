"""English search terms: stop words and the published English (Porter2) stemmer, as projections of built-in functions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import expressions as X

#: The usual English stop words of full-text search.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

#: Fixed values of the stemmer: whole words with a stem of their own, words that stay, and words that stay after the first step.
OWN_STEMS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = ["sky", "news", "howe", "atlas", "cosmos", "bias", "andes"]
KEPT_LATER = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]

#: Endings of the second and third step with what takes their place, and those that the fourth removes.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

#: Patterns of the stemmer: a word up to its first consonant after a vowel, and a short syllable at the end.
REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
FIRST_REGION = f"^(?:gener|commun|arsen)|{REGION}"
SHORT = "[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$"
WORD = r"[\p{L}\p{N}]+"


def longest_first(endings) -> str:
    return "|".join(sorted(endings, key=lambda e: (-len(e), e)))


def is_stop_word(word: Column) -> Column:
    return word.isin(*STOP_WORDS)


def without(w: Column, size: Column | int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - size)


def region(text: Column, pattern: str) -> Column:
    """How far into the text a region begins: behind the pattern's match, or at the end."""
    return F.when(text.rlike(pattern), F.length(F.regexp_extract(text, pattern, 0))).otherwise(F.length(text))


def ending(w: Column, pattern: str) -> Column:
    return F.regexp_extract(w, f"(?:{pattern})$", 0)


def regions(w: Column) -> Column:
    """The word with the beginnings of its first and second region."""
    first = X.let(region(w, FIRST_REGION), lambda r: F.struct(r.alias("first"), (r + region(F.substring(w, r + 1, F.length(w)), REGION)).alias("second")))
    return X.let(first, lambda r: F.struct(w.alias("w"), r["first"].alias("first"), r["second"].alias("second")))


def changed(s: Column, rule: Callable[[Column, Column, Column], Column]) -> Column:
    """The state with its word replaced by rule(word, first, second)."""
    return X.let(s, lambda v: F.struct(rule(v["w"], v["first"], v["second"]).alias("w"), v["first"].alias("first"), v["second"].alias("second")))


def plural(w: Column, first: Column, second: Column) -> Column:
    short = without(w, F.when(F.length(w) > 4, 2).otherwise(1))
    return F.when(w.rlike("sses$"), without(w, 2)).when(w.rlike("ie[ds]$"), short).when(w.rlike("[us]s$"), w).when(w.rlike("[aeiouy].+s$"), without(w, 1)).otherwise(w)


def verb(w: Column, first: Column, second: Column) -> Column:
    def mended(cut: Column) -> Column:
        whole = F.concat(cut, F.lit("e"))
        once = F.when(cut.rlike("(?:at|bl|iz)$"), whole).when(cut.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), without(cut, 1))
        return once.when((first >= F.length(cut)) & cut.rlike(SHORT), whole).otherwise(cut)

    def rule(end: Column) -> Column:
        cut = without(w, F.length(end))
        doubled = F.when(F.length(cut) >= first, F.concat(cut, F.lit("ee"))).otherwise(w)
        return F.when(end.startswith("eed"), doubled).when((end != "") & cut.rlike("[aeiouy]"), X.let(cut, mended)).otherwise(w)

    return X.let(ending(w, "eedly|eed|ingly|edly|ing|ed"), rule)


def final_y(w: Column, first: Column, second: Column) -> Column:
    return F.regexp_replace(w, "^(.+[^aeiouy])[yY]$", "$1i")


def replaced(table: dict[str, str]) -> Callable[[Column, Column, Column], Column]:
    new = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    def rule(w: Column, first: Column, second: Column) -> Column:
        def fits(end: Column) -> Column:
            cut = without(w, F.length(end))
            held = ((end != "ogi") | cut.endswith("l")) & ((end != "li") | cut.rlike("[cdeghkmnrt]$")) & ((end != "ative") | (F.length(cut) >= second))
            return F.when((end != "") & (F.length(cut) >= first) & held, F.concat(cut, F.element_at(new, end))).otherwise(w)

        return X.let(ending(w, longest_first(table)), fits)

    return rule


def removed(w: Column, first: Column, second: Column) -> Column:
    def rule(end: Column) -> Column:
        cut = without(w, F.length(end))
        return F.when((end != "") & (F.length(cut) >= second) & ((end != "ion") | cut.rlike("[st]$")), cut).otherwise(w)

    return X.let(ending(w, longest_first(STEP_4)), rule)


def last_letter(w: Column, first: Column, second: Column) -> Column:
    cut = without(w, 1)
    e = w.endswith("e") & ((F.length(cut) >= second) | ((F.length(cut) >= first) & ~cut.rlike(SHORT)))
    return F.when(e | (w.endswith("ll") & (F.length(cut) >= second)), cut).otherwise(w)


def stem(word: Column) -> Column:
    """The stem of a lower-case word; null stays null. Some twenty patterns, best applied once a distinct word; one expression, each step a value of its own."""
    own = F.create_map(*[F.lit(x) for pair in (OWN_STEMS | {k: k for k in KEPT}).items() for x in pair])

    def found(w: Column) -> Column:
        marked = F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "([aeiouy])y", "$1Y")
        singular = changed(X.let(marked, regions), plural)
        rules = [verb, final_y, replaced(STEP_2), replaced(STEP_3), removed, last_letter]

        def rest(s: Column) -> Column:
            out = s
            for rule in rules:
                out = changed(out, rule)
            return F.when(s["w"].isin(*KEPT_LATER), s["w"]).otherwise(F.translate(out["w"], "Y", "y"))

        return F.when(F.length(w) <= 2, w).otherwise(F.coalesce(F.element_at(own, w), X.let(singular, rest)))

    return X.let(word, found)


def with_stems(words: DataFrame, word: str, name: str = "stem") -> DataFrame:
    return words.withColumn(name, stem(F.col(word)))


#: Words whose terms a worker keeps; words told apart by their endings, as patterns of Python.
KNOWN_TERMS = 1 << 18
_STOPPED, _OWN = frozenset(STOP_WORDS), OWN_STEMS | {k: k for k in KEPT}
_FIRST, _REGION, _SHORT, _VOWEL, _AFTER_VOWEL = (re.compile(p) for p in (FIRST_REGION, REGION, SHORT, "[aeiouy]", "([aeiouy])y"))
_PLURAL, _VERB, _FINAL_Y = re.compile("[aeiouy].+s$"), re.compile("(?:eedly|eed|ingly|edly|ing|ed)$"), re.compile("^(.+[^aeiouy])[yY]$")
_TABLES = [(tuple(t), re.compile(f"(?:{longest_first(t)})$"), t) for t in (STEP_2, STEP_3)]
_LAST_ENDS, _LAST = tuple(STEP_4), re.compile(f"(?:{longest_first(STEP_4)})$")
_DOUBLED = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def stem_of(word: str) -> str:
    """stem of a Python string, for texts that are read word by word."""
    if len(word) <= 2 or word in _OWN:
        return _OWN.get(word, word)
    w = _AFTER_VOWEL.sub(r"\1Y", "Y" + word[1:] if word[0] == "y" else word)
    found = _FIRST.search(w)
    first = found.end() - found.start() if found else len(w)
    found = _REGION.search(w[first:])
    second = first + (found.end() if found else len(w) - first)
    if w.endswith("s"):
        if w.endswith("sses"):
            w = w[:-2]
        elif w.endswith("ies"):
            w = w[:-2] if len(w) > 4 else w[:-1]
        elif not w.endswith(("us", "ss")) and _PLURAL.search(w):
            w = w[:-1]
    elif w.endswith("ied"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    if w in KEPT_LATER:
        return w
    found = w.endswith(("ed", "ing", "edly", "ingly")) and _VERB.search(w)
    if found:
        cut = w[: found.start()]
        if found[0].startswith("eed"):
            w = cut + "ee" if len(cut) >= first else w
        elif _VOWEL.search(cut):
            if cut.endswith(("at", "bl", "iz")):
                w = cut + "e"
            elif cut.endswith(_DOUBLED):
                w = cut[:-1]
            else:
                w = cut + "e" if first >= len(cut) and _SHORT.search(cut) else cut
    if w.endswith(("y", "Y")):
        w = _FINAL_Y.sub(r"\1i", w)
    for ends, pattern, table in _TABLES:
        found = w.endswith(ends) and pattern.search(w)
        if found and found.start() >= first:
            end, cut = found[0], w[: found.start()]
            if (end != "ogi" or cut.endswith("l")) and (end != "li" or cut.endswith(tuple("cdeghkmnrt"))) and (end != "ative" or len(cut) >= second):
                w = cut + table[end]
    found = w.endswith(_LAST_ENDS) and _LAST.search(w)
    if found and found.start() >= second and (found[0] != "ion" or w[: found.start()].endswith(("s", "t"))):
        w = w[: found.start()]
    cut = w[:-1]
    if (w.endswith("e") and (len(cut) >= second or (len(cut) >= first and not _SHORT.search(cut)))) or (w.endswith("ll") and len(cut) >= second):
        w = cut
    return w.replace("Y", "y")


@lru_cache(KNOWN_TERMS)
def term_of(word: str) -> str | None:
    """The stem of a word of a text, None of a stop word."""
    return None if word in _STOPPED else stem_of(word)
