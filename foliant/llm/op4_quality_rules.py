"""Quality rules: suffix-array repetition.

Each text becomes a suffix array over its words, built by prefix doubling for a whole batch of texts at once. Neighbours
in the array give the longest common prefixes; each prefix is a maximal repeated substring of the text. The union of the
repeats of at least `min_repeat` words must not cover more than `max_covered` of the words, and no repeat may be longer
than `max_longest` words.

Defined cases: a null text counts as empty; an empty text has zero counts and fails the base rule; repeated rows and ids are
judged one by one, equal texts alike; repeats of equal length count alike, as their union and the longest length are taken; a very long text makes a batch
alone, whose arrays take some hundred bytes a word; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import each_batch, table, texts_as_bytes

OUT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "longest_repeat long, covered_words long"
)
ARROW = pa.schema([(f.split()[0], pa.int64()) for f in OUT.split(", ")])


def longest_repeats(words: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each position the longest run of words from there that also occurs elsewhere in the same document."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    key = docs.astype(np.int64) << 32 | words
    order = np.argsort(key, kind="stable")
    first = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, k = [rank], 1
    sizes = np.bincount(rank, minlength=n)
    tied = np.flatnonzero(sizes[rank] > 1)
    while len(tied):
        rank, old = rank.copy(), rank[tied].astype(np.int64)
        after = np.zeros(len(tied), np.int64)
        inside = tied + k < n
        after[inside] = rank[tied[inside] + k].astype(np.int64) + 1
        key = old * (n + 2) + after
        order = np.argsort(key, kind="stable")
        key, group, at = key[order], old[order], np.arange(len(tied))
        new_key = np.concatenate(([True], key[1:] != key[:-1]))
        new_group = np.concatenate(([True], group[1:] != group[:-1]))
        start = np.maximum.accumulate(np.where(new_key, at, 0)) - np.maximum.accumulate(np.where(new_group, at, 0))
        rank[tied[order]] = group + start
        levels.append(rank)
        k *= 2
        many = np.bincount(np.cumsum(new_key) - 1)
        tied = np.sort(tied[order][many[np.cumsum(new_key) - 1] > 1])
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    pairs = np.flatnonzero(levels[0][a] == levels[0][b])
    i, j, common = a[pairs], b[pairs], np.zeros(len(pairs), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = i + common, j + common
        ok = (x < n) & (y < n)
        ok[ok] = levels[level][x[ok]] == levels[level][y[ok]]
        common[ok] += 1 << level
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, i, common)
    np.maximum.at(longest, j, common)
    return longest


def covered(longest: np.ndarray, least: int, span: int | None = None) -> np.ndarray:
    """Marks the words inside a repeat of at least `least` words; with span, only its first `span` words count."""
    at = np.flatnonzero(longest >= least)
    ends = at + (longest[at] if span is None else span)
    n = len(longest)
    return np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(ends, minlength=n + 1))[:n] > 0


def measure(texts: list[bytes], min_repeat: int) -> dict[str, np.ndarray]:
    """The counts of each text."""
    spaces, symbols = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
    split = [t.split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    ids: dict[bytes, int] = {}
    words = np.fromiter((ids.setdefault(w, len(ids)) for ws in split for w in ws), np.int64, int(counts.sum()))
    docs = np.repeat(np.arange(len(texts)), counts)
    longest = longest_repeats(words, docs)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        return np.bincount(docs[mask], minlength=len(texts)).astype(np.int64)

    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, docs, longest)
    dup_lines = []
    for t in texts:
        seen: set[bytes] = set()
        lines = [x for x in t.split(b"\n") if x.strip()]
        seen.update(lines)
        dup_lines.append(len(lines) - len(seen))
    return {
        "n_words": counts,
        "word_chars": np.array([len(t.translate(None, spaces).decode("utf-8", "replace")) for t in texts], np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, symbols)) for t in texts], np.int64),
        "n_dup_lines": np.array(dup_lines, np.int64),
        "n_repeat_words": per_doc(covered(longest, 3, 3)),
        "longest_repeat": most,
        "covered_words": per_doc(covered(longest, min_repeat)),
    }


def suffix_array_rules(docs: DataFrame, *, min_repeat: int = 8, max_covered: float = 0.3, max_longest: int = 100) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of docs (doc_id, text)."""

    def rules(cols: dict) -> dict:
        texts = texts_as_bytes(cols["text"])
        return {"doc_id": pc.cast(cols["doc_id"], pa.int64())} | measure(texts, min_repeat)

    counts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each_batch(rules, ARROW, 2000), OUT)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = (F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return counts.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_rules(table(spark, sf_dir, "documents"))
