"""Suffix-array dedup: a hash-compared suffix sort of the windows that can recur.

A window is `width` bytes of one text. Each window is owned by the position of its least hashed `gram` bytes (the leftmost of equals), so equal windows
have equal owners at equal offsets, and an owner has a stretch of consecutive windows. Owners whose gram stands once in the corpus, nearly all of them,
own windows that stand once. Of owners that agree in gram, stretch and all bytes, only the first can own first windows. What differs around an equal
gram is sorted: in groups of equal gram and offset, a mergesort of suffixes compares two of them by binary search for their longest common extension with
polynomial prefix hashes. Neighbours are then compared byte by byte; if a hash has lied, the group is sorted again under another base. In each run of
equal windows the first in table order stays.

A group of one gram with more than `most` members is split by halves of its offsets, whose windows share a longer middle, and again until it is small or
holds one offset; then its windows agree, and a grouped minimum takes the sort's place. So no key needs a large group. Owners stand as two 64-bit hashes of
different bases and a stretch until the sort, which sees bytes.

Defined cases: a null text counts as empty; texts under `width` bytes and empty ones keep all; a null doc_id comes after all others; rows that share an id,
equal ones too, stand one after the other in the order in which the table is read; a very long text is hashed in blocks; other columns, whatever their
names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import discard, join_counted, mix, pieces, release, stash, table

#: Odd multipliers; the first two are used unless a verification fails.
BASES = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F]
OWNERS = pa.schema([("doc", pa.int64()), ("copy", pa.int64()), ("k", pa.int64()), ("c", pa.int64()), ("pos", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("end", pa.int64())])
SPANS = pa.schema([("doc", pa.int64()), ("copy", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
OUT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({'int64': 'long', 'int32': 'int', 'binary': 'binary'})[str(f.type)]}" for f in schema)


@lru_cache(8)
def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up, down = (np.full(size, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Prefixes:
    """Polynomial prefix hashes of bytes; equal stretches hash alike wherever they lie."""

    def __init__(self, data: np.ndarray, base: int):
        up, self.down = powers(base, 1 << max(16, int(len(data) + 1).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        return (self.sums[starts + sizes] - self.sums[starts]) * self.down[starts]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def owners(data: np.ndarray, ends: np.ndarray, width: int, gram: int, block: int = 1 << 17) -> tuple[np.ndarray, ...]:
    """Position, first and last owned window start, gram hash and hash of all owned bytes of each owner; ends: where each text ends."""
    found, begin, last = [], 0, len(data) - width
    text_end = np.asarray(ends)
    while begin <= last:
        stop = min(begin + block, last + 1)
        part = data[begin : stop + width - 1]
        one, two = (Prefixes(part, b) for b in BASES[:2])
        grams = mix(one.of(np.arange(len(part) - gram + 1), gram))
        place = np.uint64((1 << 20) - 1)
        least = sliding_least(grams & ~place | np.arange(len(grams), dtype=np.uint64), width - gram + 1)
        start = np.arange(stop - begin)
        fits = start + begin + width <= text_end[np.searchsorted(text_end, start + begin, side="right")]
        owner = np.where(fits, (least & place).astype(np.int64), -1)
        edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        low, high = edge, np.append(edge[1:], len(owner)) - 1
        after = stop
        if stop <= last and len(low) > 1:  # the last stretch may go on in the next block
            after, low, high = begin + int(low[-1]), low[:-1], high[:-1]
        ok = owner[low] >= 0
        low, high = low[ok], high[ok]
        at = owner[low]
        c = mix(two.of(low, high - low + width) ^ mix((at - low).astype(np.uint64) << np.uint64(32) | (high - low).astype(np.uint64)))
        found.append((at + begin, low + begin, high + begin, grams[at], c))
        begin = after
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found))


def union(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the spans of each row that touch; spans sorted by row and start, of equal length or ends that never fall."""
    if not len(row):
        return row, start, end
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] > end[:-1])))
    head = np.flatnonzero(new)
    return row[head], start[head], end[np.append(head[1:], len(row)) - 1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, and where each ends; null counts as empty."""
    texts = [x or b"" for x in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))


def emit_owners(width: int, gram: int):
    """A mapInArrow function: the owners of each text once, and spans (start in pos, end; no k) of those it repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for column in pieces(batch.column("text")):
                data, ends = text_bytes(column)
                doc, copy = (batch.column(x).slice(done, len(column)).to_numpy(zero_copy_only=False) for x in ("doc", "copy"))
                done += len(column)
                pos, low, high, k, c = owners(data, ends, width, gram)
                row = np.searchsorted(ends, pos, side="right")
                base = (ends - np.diff(ends, prepend=0))[row] if len(row) else row
                order = np.lexsort((pos, c, k, row))
                same = np.concatenate(([False], (row[order][1:] == row[order][:-1]) & (k[order][1:] == k[order][:-1]) & (c[order][1:] == c[order][:-1])))[: len(order)]
                again = np.sort(order[same])
                first = np.sort(order[~same])
                r, s, e = union(row[again], (low - base)[again], (high - base)[again] + width)
                n, m = len(first), len(r)
                none = [None] * m
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate((doc[row[first]], doc[r])), pa.int64()), pa.array(np.concatenate((copy[row[first]], copy[r])), pa.int64()),
                    pa.concat_arrays([pa.array(k[first].view(np.int64)), pa.array(none, pa.int64())]), pa.concat_arrays([pa.array(c[first].view(np.int64)), pa.array(none, pa.int64())]),
                    pa.array(np.concatenate(((pos - base)[first], s)), pa.int64()),
                    pa.array(np.concatenate(((pos - high)[first], np.zeros(m, np.int64))), pa.int32()), pa.array(np.concatenate(((pos - low)[first], np.zeros(m, np.int64))), pa.int32()),
                    pa.concat_arrays([pa.array([None] * n, pa.int64()), pa.array(e, pa.int64())]),
                ], schema=OWNERS)
        pa.default_memory_pool().release_unused()

    return run


CONTEXTS = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("copy", pa.int64()), ("pos", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("at", pa.int32()), ("bytes", pa.binary())])


def emit_contexts(width: int):
    """A mapInArrow function: the bytes of all owned windows of each wanted owner (k, pos, lo, hi) of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for column in pieces(batch.column("text")):
                texts = [x or b"" for x in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]
                wanted = batch.column("wanted").slice(done, len(column))
                row = np.repeat(np.arange(len(column)), wanted.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                doc, copy = (batch.column(x).slice(done, len(column)).to_numpy(zero_copy_only=False)[row] for x in ("doc", "copy"))
                done += len(column)
                k, pos, lo, hi = (wanted.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(4))
                for at in range(0, len(row), 20000):
                    cut = slice(at, at + 20000)
                    parts = [texts[r][p - h : p + width - a] for r, p, a, h in zip(row[cut], pos[cut], lo[cut], hi[cut])]
                    yield pa.RecordBatch.from_arrays([pa.array(x[cut], f.type) for x, f in zip((k, doc, copy, pos, lo, hi, hi), CONTEXTS)] + [pa.array(parts, pa.binary())], schema=CONTEXTS)
        pa.default_memory_pool().release_unused()

    return run


def common_extension(hashes: Prefixes, x: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """How many bytes from x and from y on agree, at most `width`: the whole first, then by binary search."""
    low = np.where(hashes.of(x, width) == hashes.of(y, width), width, 0)
    open_ = np.flatnonzero(low < width)
    a, b = x[open_], y[open_]
    least, most = np.zeros(len(open_), np.int64), np.full(len(open_), width - 1)
    while (least < most).any():
        middle = (least + most + 1) // 2
        same = hashes.of(a, middle) == hashes.of(b, middle)
        least, most = np.where(same, middle, least), np.where(same, most, middle - 1)
    low[open_] = least
    return low


def precedes(data: np.ndarray, hashes: Prefixes, x: np.ndarray, y: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the window at x is less than that at y, and whether both are equal."""
    common = common_extension(hashes, x, y, width)
    same = common == width
    at = np.where(same, 0, common)
    return ~same & (data[x + at] < data[y + at]), same


def merge_sort(data: np.ndarray, hashes: Prefixes, starts: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """A stable order of the windows within each group [begin, end) of slots: runs of doubled length are merged in all groups at once.

    The new place of a window is its place in its own run and, by binary search, that in the run beside it.
    """
    order, run, slots = np.arange(len(starts)), 1, np.arange(len(starts))
    longest = int((end - begin).max(initial=0))
    while run < longest:
        number = (slots - begin) // run
        beside = begin + (number ^ 1) * run
        own = slots - begin - number * run
        low = np.minimum(beside, end)
        high = np.minimum(beside + run, end)
        from_, right = low.copy(), (number & 1).astype(bool)
        active = np.flatnonzero(low < high)
        while len(active):
            middle = (low[active] + high[active]) // 2
            mine, other = starts[order[active]], starts[order[middle]]
            less, same = precedes(data, hashes, other, mine, width)
            on = less | (same & right[active])
            low[active] = np.where(on, middle + 1, low[active])
            high[active] = np.where(on, high[active], middle)
            active = active[low[active] < high[active]]
        place = begin + (number >> 1) * 2 * run + own + (low - from_)
        merged = order.copy()  # a hash that lies may give one place to two
        merged[place] = order
        order, run = merged, 2 * run
    return order


def sorted_windows(data: np.ndarray, starts: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int, bases: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of the windows in each group, and whether a window equals the one before it there; every neighbour is compared byte by byte."""
    for base in bases or BASES:
        hashes = Prefixes(data, base)
        order = merge_sort(data, hashes, starts, begin, end, width)
        equal, right = np.zeros(len(starts), bool), bool((np.bincount(order, minlength=len(order)) == 1).all())
        inner = np.flatnonzero(np.arange(len(starts)) > begin)
        for at in range(0, len(inner), 1 << 13):
            y = inner[at : at + (1 << 13)]
            a, b = (data[starts[order[z]][:, None] + np.arange(width)] for z in (y - 1, y))
            differ = a != b
            first = differ.argmax(axis=1)
            equal[y] = ~differ[np.arange(len(y)), first]
            right &= bool((equal[y] | (a[np.arange(len(y)), first] < b[np.arange(len(y)), first])).all())
        if right:
            return order, equal
    raise RuntimeError("all bases collide")


def later_windows(width: int):
    """An applyInArrow function of a bucket of contexts: spans of the windows that an earlier one of the same key equals."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc", "ascending"), ("copy", "ascending"), ("pos", "ascending")])
        key, doc, copy, pos, lo, hi, at = (rows.column(f.name).to_numpy() for f in list(CONTEXTS)[:-1])
        texts = rows.column("bytes").to_pylist()
        data = np.frombuffer(b"".join(texts), np.uint8)
        base = np.cumsum([0, *map(len, texts)])[:-1] + at
        many = hi - lo + 1
        row = np.repeat(np.arange(len(key)), many)
        offset = np.repeat(hi, many) - (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many))
        _, number = np.unique(key, return_inverse=True)
        group = number[row] * (1 << 10) + offset if width <= 1 << 10 else number[row] * width + offset
        order = np.argsort(group, kind="stable")
        group, row, offset = group[order], row[order], offset[order]
        head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(head, len(group)))
        begin, end = np.repeat(head, size), np.repeat(head + size, size)
        some = end - begin > 1
        slots = np.cumsum(some) - 1
        shift = np.arange(len(some))[some] - slots[some]
        row, offset, begin, end = row[some], offset[some], begin[some] - shift, end[some] - shift
        if not len(row):
            return SPANS.empty_table()
        order, equal = sorted_windows(data, base[row] - offset, begin, end, width)
        gone = order[equal]
        row, start = row[gone], (pos[row] - offset)[gone]
        order = np.lexsort((start, row))
        r, s, e = union(row[order], start[order], start[order] + width)
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (doc[r], copy[r], s, e)], schema=SPANS)

    return run


def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unites the spans of each text and takes their bytes out."""
    for batch in batches:
        done = 0
        for column in pieces(batch.column("text")):
            texts = [x or b"" for x in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]
            found = batch.column("spans").slice(done, len(column))
            sizes = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(column)), sizes)
            start, end = (found.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            order = np.lexsort((start, row))
            row, start, end = row[order], start[order], end[order]
            if len(row):  # the furthest end so far within the text
                reach = 1 + int(end.max())
                end = np.maximum.accumulate(row * reach + end) - row * reach
            r, s, e = union(row, start, end)
            cuts = np.searchsorted(r, np.arange(len(texts) + 1))
            kept = []
            for i, text in enumerate(texts):
                a, b = cuts[i], cuts[i + 1]
                edges = [0, *np.stack((s[a:b], e[a:b]), 1).ravel().tolist(), len(text)]
                kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2])) if b > a else text)
            pair = pa.StructArray.from_arrays([pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=["start", "end"])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(done, len(column)), pa.array([len(t) for t in texts], pa.int64()),
                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pair), pa.array(kept, pa.binary()),
            ], names=["doc_id", "n_bytes", "spans", "kept"])
            done += len(column)
    pa.default_memory_pool().release_unused()


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, text and the row's place in table order (doc, copy); and whether doc alone tells it, as ids are neither null nor shared."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    alone = rows.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty()
    if alone:
        return rows.withColumns({"doc": F.col("doc_id"), "copy": F.lit(0).cast("long")}), True
    at = F.monotonically_increasing_id()
    return stash(rows.withColumns({"doc": F.coalesce("doc_id", F.lit((1 << 63) - 1)), "copy": F.when(F.col("doc_id").isNull(), at + (1 << 62)).otherwise(at)})), False


def spans_of(rows: DataFrame, width: int) -> DataFrame:
    """The bytes of all windows of owners (doc, copy, pos, lo, hi)."""
    return rows.select("doc", "copy", (F.col("pos") - F.col("hi")).alias("start"), (F.col("pos") - F.col("lo") + width).alias("end"))


def split_large(contexts: DataFrame, width: int, gram: int, most: int, place: Column) -> tuple[DataFrame, list[DataFrame]]:
    """Contexts in groups (key) of at most `most`, and spans of the later windows of larger groups whose windows are all equal."""
    open_ = contexts.withColumns({"x": F.lit(0), "y": F.lit(width - gram)})
    small: list[DataFrame] = []
    settled: list[DataFrame] = []
    while True:
        large = stash(open_.groupBy("key").count().filter(F.col("count") > most).select("key"))
        if not large.stashed_rows:
            break
        hot, calm = (join_counted(open_, large, "key", how) for how in ("left_semi", "left_anti"))
        small.append(calm)  # what is small enough is not looked at again
        middle = F.floor((F.col("x") + F.col("y")) / 2).cast("int")
        halves = F.array(F.struct(F.col("x").alias("x"), middle.alias("y")), F.struct((middle + 1).alias("x"), F.col("y").alias("y")))
        parts = hot.withColumn("half", F.explode(halves)).filter("lo <= half.y AND hi >= half.x")
        parts = parts.withColumns({"x": F.col("half.x"), "y": F.col("half.y"), "lo": F.greatest("lo", "half.x"), "hi": F.least("hi", "half.y")}).drop("half")
        shared = F.expr(f"substring(bytes, at - x + 1, x + {width} - y)")
        parts = stash(parts.withColumn("key", F.xxhash64("key", "x", "y", shared)))
        one = parts.filter("x = y")
        first = one.groupBy("key").agg(F.min(place).alias("first"))
        settled.append(spans_of(one.join(first, "key").filter(place != F.col("first")), width))
        open_ = parts.filter("x < y")
    out = open_
    for part in small:
        out = out.unionByName(part)
    return out, settled


def suffix_dedup(docs: DataFrame, *, width: int = 100, gram: int = 32, most: int = 2048, bucket: int = 4096) -> DataFrame:
    """doc_id, n_bytes, spans (start, end; removed bytes, maximal) and kept (the other bytes) of every row of docs (doc_id, text).

    Removed is each byte covered by a string of `width` bytes that also starts earlier: in a row of smaller doc_id, or in the same text. `gram`: bytes
    hashed to find owners, at most `width`; `bucket`: contexts sorted in one group.
    """
    rows, alone = numbered(docs)
    place = F.col("doc") if alone else F.struct("doc", "copy")
    found = stash(rows.select("doc", "copy", "text").mapInArrow(emit_owners(width, gram), ddl(OWNERS)))
    held = found.filter("k IS NOT NULL").drop("end")
    spans = [stash(found.filter("k IS NULL").select("doc", "copy", F.col("pos").alias("start"), "end"))]
    recurring = held.groupBy("k").agg(F.count("*").alias("n"), F.min("c").alias("c_min"), F.max("c").alias("c_max"), F.min(place).alias("first"))
    recurring = stash(recurring.filter("n > 1").select("k", (F.col("c_min") != F.col("c_max")).alias("differ"), "first"))
    release(docs.sparkSession)
    again = stash(held.join(recurring, "k"))
    discard(found, recurring)
    release(docs.sparkSession)
    spans.append(spans_of(again.filter(~F.col("differ") & (place != F.col("first"))), width))
    mixed = again.filter("differ").drop("first")
    told = stash(mixed.join(mixed.groupBy("k", "c").agg(F.min(place).alias("first")), ["k", "c"]))
    spans.append(spans_of(told.filter(place != F.col("first")), width))
    wanted = told.filter(place == F.col("first")).groupBy("doc", "copy").agg(F.collect_list(F.struct("k", "pos", "lo", "hi")).alias("wanted"))
    contexts = stash(rows.select("doc", "copy", "text").join(wanted, ["doc", "copy"]).mapInArrow(emit_contexts(width), ddl(CONTEXTS)))
    release(docs.sparkSession)
    buckets = max(1, -(-contexts.stashed_rows // bucket))
    groups, settled = split_large(contexts, width, gram, most, place)
    dealt = groups.select(*CONTEXTS.names, F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    later = dealt.groupBy("bucket").applyInArrow(lambda t: later_windows(width)(t.drop_columns("bucket")), ddl(SPANS))
    parts = [*spans, *settled, later]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = stash(every.groupBy("doc", "copy").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    discard(spans[0], again, told, contexts)
    release(docs.sparkSession)
    return rows.join(every, ["doc", "copy"], "left").select("doc_id", "text", "spans").mapInArrow(cut_texts, OUT)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
