"""Periodic run detection by the runs theorem.

A run is a maximal stretch of words whose words a period apart are identical. Under one of two opposite orders of the words, the longest Lyndon word
that starts at some position of the run is one period of it. For a batch of texts at once, ranks of suffixes (the inverse suffix array, by prefix
doubling) give the longest Lyndon word at each position as the way to the next smaller rank, or under the opposite order to the next greater one. Each
such root is extended to both sides by longest common extensions: the least of a stretch of the array of common prefixes, from a sparse table over
blocks of it; to the left over the reversed words. A text ends with a word greater than all, which ends every run, so one suffix array serves both orders.

Defined cases: a null or empty text has no words and no runs; a text of one repeated word is one run of period 1; rows are judged one by one, whether or
not they share ids or texts; a very long text makes a batch alone, whose arrays take some hundred bytes a word; other columns, whatever their names, are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import WORD, each_batch, table, texts_as_bytes, unused

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
OUT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
BLOCK = 16


class Minima:
    """Least values of stretches of an array: a sparse table over blocks of BLOCK values."""

    def __init__(self, values: np.ndarray):
        self.values, self.n = values, len(values)
        self.blocks = -(-self.n // BLOCK)
        padded = np.full(self.blocks * BLOCK, np.iinfo(values.dtype).max, values.dtype)
        padded[: self.n] = values
        self.levels = [padded.reshape(-1, BLOCK).min(axis=1)]
        while 2 << len(self.levels) - 1 <= self.blocks:
            low, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(low[:-half], low[half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least of values[first..last] for each pair first <= last."""
        out = np.minimum(self.values[first], self.values[last])
        left, right = first // BLOCK, last // BLOCK
        for t in range(1, BLOCK):
            at = first + t
            ok = (at < last) & (at // BLOCK == left)
            out[ok] = np.minimum(out[ok], self.values[at[ok]])
            at = last - t
            ok = (at > first) & (at // BLOCK == right)
            out[ok] = np.minimum(out[ok], self.values[at[ok]])
        inner = np.flatnonzero(right - left > 1)
        if len(inner):
            a, size = left[inner] + 1, right[inner] - left[inner] - 1
            level = np.frexp(size)[1] - 1
            for k in np.unique(level):
                some = level == k
                x, y = a[some], a[some] + size[some] - (1 << k)
                out[inner[some]] = np.minimum(out[inner[some]], np.minimum(self.levels[k][x], self.levels[k][y]))
        return out

    def next_smaller(self, near: int = 8) -> np.ndarray:
        """For each position the first later one of smaller value, or n: some steps one by one, then by blocks."""
        values, out = self.values, np.full(self.n, self.n, np.int64)
        open_ = np.arange(self.n)
        for t in range(1, near + 1):
            open_ = open_[open_ + t < self.n]
            hit = values[open_ + t] < values[open_]
            out[open_[hit]] = open_[hit] + t
            open_ = open_[~hit]
        at = open_ + near + 1

        def walk(open_: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """To the next start of a block, unless a smaller value comes before it."""
            for _ in range(BLOCK):
                go = (at < self.n) & (at % BLOCK != 0)
                hit = go & (values[np.minimum(at, self.n - 1)] < values[open_])
                out[open_[hit]] = at[hit]
                at = np.where(go, at + 1, at)[~hit]
                open_ = open_[~hit]
            return open_, at

        open_, at = walk(open_, at)
        open_, at = open_[at < self.n], at[at < self.n]
        block = at // BLOCK
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            skip = block < len(level)
            skip[skip] = level[block[skip]] >= values[open_[skip]]
            block[skip] += 1 << k
        found = block < self.blocks
        open_, at = open_[found], block[found] * BLOCK
        for t in range(BLOCK):
            hit = values[np.minimum(at + t, self.n - 1)] < values[open_]
            out[open_[hit]] = at[hit] + t
            open_, at = open_[~hit], at[~hit]
        return out


class Extensions:
    """Suffix ranks of the words of many texts, and longest common extensions to the right within a text."""

    def __init__(self, words: np.ndarray, docs: np.ndarray):
        n = self.n = len(words)
        key = docs.astype(np.int64) << 32 | words
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        levels, size = [rank], 1
        tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        while len(tied):
            old, after = rank[tied].astype(np.int64), np.zeros(len(tied), np.int64)
            inside = tied + size < n
            after[inside] = rank[tied[inside] + size].astype(np.int64) + 1
            after[~inside] = n + 1  # the end is greater than all
            key = old * (n + 2) + after
            order = np.argsort(key, kind="stable")
            key, group, at = key[order], old[order], np.arange(len(tied))
            new = np.concatenate(([True], key[1:] != key[:-1]))
            head = np.concatenate(([True], group[1:] != group[:-1]))
            rank = rank.copy()
            rank[tied[order]] = group + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
            levels.append(rank)
            size *= 2
            place = np.cumsum(new) - 1
            tied = np.sort(tied[order][np.bincount(place)[place] > 1])
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        common = np.zeros(n, np.int32)
        at = np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]]) + 1
        i, j, length = suffixes[at - 1], suffixes[at], np.zeros(len(at), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = i + length, j + length
            ok = (x < n) & (y < n)
            ok[ok] = levels[k][x[ok]] == levels[k][y[ok]]
            length[ok] += 1 << k
        common[at] = length
        self.rank, self.prefixes = rank, Minima(common)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are identical; i <> j, both in one text."""
        if not len(i):
            return np.zeros(0, np.int64)
        a, b = self.rank[i].astype(np.int64), self.rank[j].astype(np.int64)
        return self.prefixes.least(np.minimum(a, b) + 1, np.maximum(a, b)).astype(np.int64)


def find_runs(words: np.ndarray, docs: np.ndarray, least_length: int, least_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of at least so many words and periods (2 or more), by start, then period; positions count over all texts."""
    n, empty = len(words), np.zeros(0, np.int64)
    if n < 2:
        return empty, empty, empty
    right = Extensions(words, docs)
    ends = np.searchsorted(docs, docs, side="right")
    roots = [Minima(x).next_smaller() for x in (right.rank, -right.rank)]
    i, j = np.concatenate([np.arange(n)] * 2), np.concatenate(roots)
    # The first root of a run starts less than a period after it, so it goes on for at least so many words behind its end.
    need = np.maximum(np.maximum(least_length - 2 * (j - i), (least_exponent - 2) * (j - i)) + 1, 1)
    ok = j + need <= ends[i]
    i, j, need = i[ok], j[ok], need[ok]
    for at in (0, 1, 2):  # its first, last and middle words are compared before the stretch is looked up
        step = (need - 1) * at // 2
        ok = words[i + step] == words[j + step]
        i, j, need = i[ok], j[ok], need[ok]
    after = right.common(i, j)
    ok = after >= need
    i, j, after = i[ok], j[ok], after[ok]
    if not len(i):
        return empty, empty, empty
    some = np.isin(docs, np.unique(docs[i]))
    place = np.cumsum(some) - 1  # positions among the texts that have roots left, then from the end
    left = Extensions(words[some][::-1], docs[some][::-1])
    inner = np.flatnonzero((i > 0) & (docs[np.maximum(i - 1, 0)] == docs[i]))
    before = np.zeros(len(i), np.int64)
    before[inner] = left.common(left.n - place[i[inner]], left.n - place[j[inner]])
    start, period, length = i - before, j - i, j + after - i + before
    ok = length >= np.maximum(least_length, least_exponent * period)
    found = np.unique(np.stack([start[ok], period[ok], length[ok]], axis=1), axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def collapse(texts: list[bytes], least_length: int, least_exponent: int) -> dict:
    """Number of words, runs and collapsed text of each text."""
    split = [t.split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    begins = np.concatenate(([0], np.cumsum(counts)))
    ids: dict[bytes, int] = {}
    words = np.fromiter((ids.setdefault(w, len(ids)) for ws in split for w in ws), np.int64, int(begins[-1]))
    docs = np.repeat(np.arange(len(texts)), counts)
    start, length, period = find_runs(words, docs, least_length, least_exponent)
    dropped = np.cumsum(np.bincount(start + period, minlength=len(words) + 1) - np.bincount(start + length, minlength=len(words) + 1)) > 0
    of = docs[start] if len(start) else np.zeros(0, np.int64)
    cut = np.searchsorted(of, np.arange(len(texts) + 1))
    kept = []
    for k, ws in enumerate(split):
        if cut[k] < cut[k + 1]:
            ws = [w for w, gone in zip(ws, dropped[begins[k] : begins[k + 1]]) if not gone]
        kept.append(b" ".join(ws))
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - begins[of], length, period)], fields=list(RUN))
    return {"n_words": counts, "runs": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), runs), "collapsed": pa.array(kept, pa.binary())}


def periodic_runs(docs: DataFrame, *, least_length: int = 6, least_exponent: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed of every row of docs (doc_id, text).

    A run has at least `least_length` words and `least_exponent` (2 or more) periods. collapsed: the words joined by one space, without those that
    stand in a run after its first period.
    """
    if least_exponent < 2:
        raise ValueError("a run has at least two periods")

    def run(cols: dict) -> dict:
        return {"doc_id": pc.cast(cols["doc_id"], pa.int64())} | collapse(texts_as_bytes(cols["text"]), least_length, least_exponent)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each_batch(run, ARROW), OUT)


def plant_runs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), where a text whose crc32(doc_id) ends in 0 repeats a stretch of its words from some word to its end."""
    words, n, h, at, period = (unused(docs.columns, x) for x in ("_words", "_n", "_h", "_at", "_period"))
    rows = docs.withColumn(h, F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(1)))
    rows = rows.withColumn(words, F.when(F.col(h) % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), 0)))
    g = F.floor(F.col(h) / 10).cast("long")
    rows = rows.withColumn(n, F.when(F.col(words).isNotNull() & (F.size(words) > 0), F.size(words)).cast("long")).withColumn(at, g % F.col(n))
    rows = rows.withColumn(period, 1 + F.floor((F.col(n) - F.col(at)) / (3 + g % 8)).cast("long"))

    def word(i: Column) -> Column:
        return F.get(F.col(words), F.when(i < F.col(at), i).otherwise(F.col(at) + (i - F.col(at)) % F.col(period)).cast("int"))

    planted = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), word), " ")
    return rows.withColumn("text", F.when(F.col(n).isNotNull(), planted).otherwise(F.col("text"))).drop(words, n, h, at, period)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(plant_runs(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.withColumn("longest", longest).withColumn("start", -F.col("longest.start")).withColumn("length", F.col("longest.length")).withColumn("period", -F.col("longest.period"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
