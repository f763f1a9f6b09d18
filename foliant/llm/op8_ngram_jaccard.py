"""N-gram Jaccard join: T-occurrence search over inverted lists with DivideSkip.

Two documents link when the Jaccard similarity of their sets of 5-word shingles is at least 0.75. Equal sets are one
node from the start. A set of n shingles shares at least T = ceil(0.75 n) of them with any similar set. DivideSkip with the
most long lists, L = T - 1, merges the n - T + 1 shortest lists of a set, where T - L = 1 occurrence makes a candidate, and probes
the long lists for the candidates only:

1. Minhash bands give star candidates; those that the search confirms join their sets into parts. This only saves work:
   a part counts as one entry in every list below.
2. Shingles are counted over one set of each part. A shingle's level is the rounded logarithm of its count, 0 beyond the `most_levels` most
   frequent; the order of all shingles is level, then hash, so the first n - T + 1 of a set are its shortest lists. The order
   only steers the work: any order gives whole results.
3. The shortest lists are built over all sets and merged. A short list gives the pairs of its parts where enough of both sets is
   left after the shingle. A long list first gives a star, from the part with most left to the others; what the search confirms joins parts,
   and the list then gives the pairs of the parts that are still apart, in chunks.
4. Candidate parts are searched by blocks: an index of at most BLOCK sets of one part against the sets of the other. In a
   block DivideSkip merges the short lists of a query as sorted runs and probes its longest lists by binary search, which gives exact
   overlaps. Only links that join different parts leave the search; the rest cannot change a component.

Defined cases: null and empty texts have no shingle and link with nothing; with fewer than five words the sequence is one shingle;
texts of any length are read whole; equal texts, ties and repeated rows or ids are one component; a row whose id is null takes part like any
other and its component is the smallest id that is not null, or null; other columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import BROADCAST_ROWS, at_most, discard, each_batch, join_counted, joined, list_array, lower_ascii, mix, release, span_hashes, stash, table, texts_as_bytes, word_spans
from foliant.llm.components import components

GRAM, PERCENT = 5, 75
BANDS, ROWS, SKETCH = 6, 3, 128
WINDOW = 0.36  # share of a set's shingles, those of lowest hash, that is kept beside its profile
BLOCK, QUERIES = 128, 256
BITS = 6  # low bits of a shingle's hash that give way to a share
LOW = np.int64((1 << BITS) - 1)
LEVEL = 58  # bit from which a ranked shingle holds its level; the sign bit stays free
SALTED = 12  # shingles of this level and above have lists dealt over several tasks, of about 2**SALTED entries each
COUNTED = 1 << 21  # shingles counted in one group, 4 bytes each
CHUNK = 1024  # parts of a long list that meet those of another chunk in one task
PARITY = 2048  # bits of a set that tell most unlike sets of a long list apart
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles, as signed numbers."""
    data, starts = joined(texts)
    begin, end = word_spans(lower_ascii(data))
    words = span_hashes(lower_ascii(data), begin, end)
    first = np.searchsorted(begin, starts)
    out = []
    with np.errstate(over="ignore"):
        rolled = words.copy()
        for k in range(1, GRAM):
            rolled[: len(words) - k] = rolled[: len(words) - k] * np.uint64(0xD6E8FEB86659FD93) + words[k:]
        rolled = mix(rolled)
        for i, j in zip(first[:-1], first[1:]):
            if j - i >= GRAM:
                out.append(np.unique(rolled[i : j - GRAM + 1].view(np.int64)))
            else:
                h = np.uint64(j - i + 977)
                for w in words[i:j]:
                    h = mix(np.array([h * np.uint64(31) + w], np.uint64))[0]
                out.append(np.array([h] * int(j > i), np.uint64).view(np.int64))
    return out


def ranked(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set in the order of level, then hash: a shingle is its level above the high bits of its hash."""
    u = mix(s.view(np.uint64))
    level = levels[(u >> np.uint64(32)) & np.uint64(len(levels) - 1)].astype(np.uint64)
    return np.sort((level << np.uint64(LEVEL) | u >> np.uint64(64 - LEVEL)).view(np.int64))


def dealt(n: int) -> int:
    """How many shingles of a set of n one of any similar set must be among."""
    return n - -(-PERCENT * n // 100) + 1


def fingerprint(s: np.ndarray) -> int:
    """A number that stands for the set."""
    with np.errstate(over="ignore"):
        u = s.view(np.uint64)
        return int(mix(np.array([np.add.reduce(mix(u)) + np.uint64(len(u))], np.uint64)).view(np.int64)[0])


def band_keys(s: np.ndarray) -> np.ndarray:
    """Band keys of the set's SKETCH lowest hashes, which are alike for similar sets."""
    with np.errstate(over="ignore"):
        low = np.multiply.outer(_SEEDS, s[:SKETCH].view(np.uint64)).min(axis=1).reshape(BANDS, ROWS)
        return mix(low[:, 0] * np.uint64(3) + mix(low[:, 1] * np.uint64(5) + mix(low[:, 2]))).view(np.int64)


def may_reach(x: np.ndarray, y: np.ndarray, n: int, m: int) -> bool:
    """Whether sets of n and m shingles can be similar, given those of lowest hash. Up to the lower end both are fully known."""
    end = min(x[-1], y[-1])
    x, y = x[: np.searchsorted(x, end, "right")], y[: np.searchsorted(y, end, "right")]
    most = len(np.intersect1d(x, y, assume_unique=True)) + min(n - len(x), m - len(y))
    return 100 * most >= PERCENT * (n + m - most)


def parity(s: np.ndarray) -> bytes:
    """PARITY bits, each whether an odd number of the set's shingles falls on it. Two sets differ in at least as many shingles as their bits do."""
    odd = np.bincount((mix(s.view(np.uint64)) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def may_overlap(bits: np.ndarray, sizes: np.ndarray, k: int, near: np.ndarray) -> np.ndarray:
    """Which of near can be similar to k, by the bits of sets of known size (0: not known, which may be)."""
    if not sizes[k]:
        return np.ones(len(near), bool)
    differ = np.bitwise_count(bits[near] ^ bits[k]).sum(axis=1, dtype=np.int64)
    most = (sizes[near] + sizes[k] - differ) // 2
    return (sizes[near] == 0) | (100 * most >= PERCENT * (sizes[near] + sizes[k] - most))


def packed(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([s.tobytes() for s in sets], pa.binary())


def divide_skip(tokens: np.ndarray, owner: np.ndarray, sizes: np.ndarray, query: np.ndarray, mu: float = 0.01) -> np.ndarray:
    """The index sets similar to query. tokens, owner: the inverted lists, sorted by token, then owner."""
    n = len(query)
    t = -(-PERCENT * n // 100)
    lo, hi = np.searchsorted(tokens, query, "left"), np.searchsorted(tokens, query, "right")
    lengths = hi - lo
    found = np.flatnonzero(lengths)
    if len(found) < t:
        return np.zeros(0, np.int64)
    skipped = min(t - 1, int(t / (mu * math.log2(max(2, lengths.max())) + 1)))
    order = found[np.argsort(lengths[found], kind="stable")]
    short, long = order[: max(0, len(order) - skipped)], order[max(0, len(order) - skipped) :]
    merged = np.sort(np.concatenate([owner[lo[i] : hi[i]] for i in short] or [owner[:0]]), kind="stable")  # merges sorted runs
    at = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1]))) if len(merged) else np.zeros(0, np.int64)
    left, overlap = merged[at], np.diff(np.concatenate((at, [len(merged)])))
    fits = (overlap >= max(1, t - len(long))) & (sizes[left] * 100 >= PERCENT * n) & (n * 100 >= PERCENT * sizes[left])
    left, overlap = left[fits], overlap[fits]
    for k, i in enumerate(long):
        lists = owner[lo[i] : hi[i]]
        at = np.searchsorted(lists, left)
        overlap = overlap + ((at < len(lists)) & (lists[np.minimum(at, len(lists) - 1)] == left))
        if k % 16 == 15:
            alive = overlap + (len(long) - k - 1) >= t
            left, overlap = left[alive], overlap[alive]
        if not len(left):
            break
    return left[100 * overlap >= PERCENT * (n + sizes[left] - overlap)]


def search_block(index: pa.Table, queries: pa.Table) -> pa.Table:
    """Links (a, b) between the block's sets and the queries that join different parts."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    if not index.num_rows or not queries.num_rows:
        return schema.empty_table()
    marks, parts = index.column("mark").to_pylist(), index.column("part").to_pylist()
    sets = [np.frombuffer(x, np.int64) for x in index.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((owner, tokens))
    tokens, owner = tokens[order], owner[order]
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out, own = [], sorted(set(parts))
    for mark, part, text in zip(queries.column("mark").to_pylist(), queries.column("part").to_pylist(), queries.column("shingles").to_pylist()):
        if all(top(p) == top(part) for p in own):
            continue
        for i in divide_skip(tokens, owner, sizes, np.frombuffer(text, np.int64)):
            a, b = top(part), top(parts[i])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((mark, marks[i]))
    return pa.Table.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=schema)


def search(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """blocks (block, mark, part, shingles); asked (block, mark, part, shingles): links found, by block."""
    own, other = (df.select(*[F.col(c).alias(c) for c in ("block", "mark", "part", "shingles")]) for df in (blocks, asked))
    return own.groupBy("block").cogroup(other.groupBy("block")).applyInArrow(search_block, "a long, b long")


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def one_each(token: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted entries without repeats; of a token's forms for one owner the one with the highest low bits stays."""
    order = np.lexsort((-(token & LOW), owner, token >> BITS))
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] >> BITS != token[:-1] >> BITS) | (owner[1:] != owner[:-1])
    return token[new], owner[new]


def feasible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets with shares a and b left from their first common shingle on can be similar: the overlap is at most a n and b m,
    and must be 3/7 (n + m)."""
    return (7 / 3 * a - 1) * (7 / 3 * b - 1) >= 1 - 1e-6


def share(token: np.ndarray) -> np.ndarray:
    return 0.75 + 0.25 * (token & LOW) / LOW


def frequent_levels(texts: DataFrame, most: int) -> np.ndarray:
    """The level of each shingle, by bits of its hash: log2 of its count of texts, rounded up; 0 for one text, and beyond the `most`
    most frequent shingles. Bounded by `most`: 4 bytes a shingle reach the driver, 8 to 16 go to each worker."""
    words = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, words // (4 * COUNTED) + 1)

    def deal(batches):
        held, many = [], 0

        def rows() -> pa.RecordBatch:
            u = mix(np.concatenate([*held, np.zeros(0, np.int64)]).view(np.uint64))
            bucket = ((u & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            high, bucket = (u >> np.uint64(32)).astype(np.uint32)[order], bucket[order]
            at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            return pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int64()), pa.array([high[i:j].tobytes() for i, j in zip(at, [*at[1:], len(high)])], pa.binary())], names=["bucket", "high"])

        for batch in batches:
            step = max(1, min(batch.num_rows, int(batch.num_rows * 5e5 / max(batch.nbytes, 1)) + 1))
            for at in range(0, batch.num_rows, step):
                held += shingles(texts_as_bytes(batch.column(0).slice(at, step)))
                many += sum(map(len, held[-step:]))
                if many > COUNTED:
                    yield rows()
                    held, many = [], 0
        if many:
            yield rows()
        pa.default_memory_pool().release_unused()

    def count(got: pa.Table) -> pa.Table:
        high = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in got.column("high").to_pylist()]))
        at = np.flatnonzero(np.concatenate(([True], high[1:] != high[:-1])))
        level = np.ceil(np.log2(np.diff(np.concatenate((at, [len(high)]))))).astype(np.int64)
        found = np.unique(level[level > 0])
        high = high[at]
        return pa.Table.from_arrays([pa.array(found), pa.array([int((level == k).sum()) for k in found], pa.int64()), pa.array([high[level == k].tobytes() for k in found], pa.binary())], schema=pa.schema([("level", pa.int64()), ("n", pa.int64()), ("high", pa.binary())]))

    found = stash(texts.mapInArrow(deal, "bucket long, high binary").groupBy("bucket").applyInArrow(count, "level long, n long, high binary"))
    lowest, listed = 99, 0
    for row in sorted(found.groupBy("level").agg(F.sum("n").alias("n")).collect(), key=lambda r: -r["level"]):
        if listed + row["n"] > most:
            break
        lowest, listed = row["level"], listed + row["n"]
    levels = np.zeros(1 << max(10, int(8 * listed).bit_length()), np.uint8)
    for row in found.filter(F.col("level") >= lowest).toLocalIterator():
        at = np.frombuffer(row["high"], np.uint32) & np.uint32(len(levels) - 1)
        levels[at] = np.maximum(levels[at], min(row["level"], 31))
    discard(found)
    return levels


def short_lists(rows: DataFrame, buckets: int, longest: int) -> DataFrame:
    """(token, a, b) from rows (part, n, low): candidate parts a < b with token null; or, of a list with more than `longest` parts, the
    shingle, a part and, in b, that part's share left. The low bits of a shingle hold the share of its set that is left, rounded up."""

    def deal(batches):
        for batch in batches:
            part, sizes = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            first = [np.frombuffer(low, np.int64)[: dealt(n)] for n, low in zip(sizes, batch.column(2).to_pylist())]
            token, owner = np.concatenate([*first, np.zeros(0, np.int64)]) & ~LOW, np.repeat(part, [len(x) for x in first])
            token |= np.concatenate([*(np.ceil((0.25 - np.arange(len(x)) / n) * 4 * LOW - 1e-6) for x, n in zip(first, sizes)), np.zeros(0)]).clip(0, LOW).astype(np.int64)
            token, owner = one_each(token, owner)
            salts = np.uint64(1) << np.maximum((token >> LEVEL) - SALTED, 0).astype(np.uint64)
            bucket = (mix((token >> BITS).view(np.uint64) + mix(owner.view(np.uint64)) % salts) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            token, owner, bucket = token[order], owner[order], bucket[order]
            at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
            ends = [*at[1:], len(bucket)]
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[i]) for i in at], pa.int64()), pa.array([token[i:j].tobytes() for i, j in zip(at, ends)], pa.binary()), pa.array([owner[i:j].tobytes() for i, j in zip(at, ends)], pa.binary())], names=["bucket", "tokens", "owners"])

    def meet(got: pa.Table) -> pa.Table:
        token, owner = one_each(*(np.concatenate([np.frombuffer(x, np.int64) for x in got.column(c).to_pylist()]) for c in ("tokens", "owners")))
        at = np.flatnonzero(np.concatenate(([True], token[1:] >> BITS != token[:-1] >> BITS)))
        size = np.diff(np.concatenate((at, [len(token)])))
        salted = token[at] >> LEVEL >= SALTED
        a, b = [owner[:0]], [owner[:0]]
        for n in np.unique(size[(size > 1) & (size <= longest) & ~salted]):
            rows = at[(size == n) & ~salted][:, None] + np.arange(n)
            for gap in range(1, int(n)):
                i, j = rows[:, :-gap].ravel(), rows[:, gap:].ravel()
                near = feasible(share(token[i]), share(token[j]))
                a.append(owner[i[near]])
                b.append(owner[j[near]])
        a, b = distinct_pairs(np.concatenate(a), np.concatenate(b))
        rest = np.repeat((size > longest) | salted, size)
        long = token[rest]
        return pa.Table.from_arrays([pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(long & ~LOW)]), pa.array(np.concatenate((a, owner[rest]))), pa.array(np.concatenate((b, long & LOW)))], schema=pa.schema([("token", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]))

    return rows.mapInArrow(deal, "bucket long, tokens binary, owners binary").groupBy("bucket").applyInArrow(meet, "token long, a long, b long")


def long_list_pairs(entries: DataFrame) -> DataFrame:
    """(a, b), a < b: the parts of each list (token, part, left, n, bits) that can be similar; the chunks of a list meet in pairs.

    n and bits (see parity) are those of the only set of a part, null for a part of several. They bound the overlap of two sets, so sets that share a passage
    and no more leave no pair, however many there are.
    """
    per = entries.groupBy("token").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    own = entries.join(per, "token").withColumn("chunk", F.pmod(F.xxhash64("part"), "chunks"))
    other = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    met = own.withColumn("other", F.explode(other)).select("token", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "chunk", "part", "left", "n", "bits")

    def pairs(got: pa.Table) -> pa.Table:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        part, left, chunk = (got.column(c).to_numpy() for c in ("part", "left", "chunk"))
        sizes = got.column("n").fill_null(0).to_numpy()
        bits = np.frombuffer(b"".join(x or bytes(PARITY // 8) for x in got.column("bits").to_pylist()), np.uint64).reshape(len(part), -1)
        one = chunk == got.column("x")[0].as_py()
        same = got.column("x")[0].as_py() == got.column("y")[0].as_py()
        i = np.flatnonzero(one)
        j = i if same else np.flatnonzero(~one)
        out_a, out_b = [], []
        for k in i:
            near = j[(part[j] > part[k]) | (not same)]
            near = near[feasible(share(left[k : k + 1]), share(left[near]))]
            near = near[may_overlap(bits, sizes, k, near)]
            out_a.append(np.minimum(part[k], part[near]))
            out_b.append(np.maximum(part[k], part[near]))
        return pa.Table.from_arrays([pa.array(np.concatenate([*x, part[:0]])) for x in (out_a, out_b)], schema=schema)

    return met.groupBy("token", "x", "y").applyInArrow(pairs, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, *, longest: int = 16, most_levels: int = 1 << 22) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text).

    longest: parts of an inverted list above which it first gives a star. most_levels: bound of the shingles whose level is known to tasks.
    Neither changes the result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    spark = docs.sparkSession
    arrow = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("mark", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def profiles(cols: dict) -> dict:
        sets = shingles(texts_as_bytes(cols["text"]))
        bands = [band_keys(s) if len(s) else s for s in sets]
        return {"doc_id": cols["doc_id"], "n_shingles": np.array([len(s) for s in sets]), "mark": [fingerprint(s) if len(s) else None for s in sets], "bands": list_array(np.concatenate(bands), [len(k) for k in bands], pa.int64())}

    known = stash(docs.mapInArrow(each_batch(profiles, arrow), "doc_id long, n_shingles long, mark long, bands array<long>"))
    real = known.filter("mark IS NOT NULL")
    # One row stands for all rows of equal sets; its text is found again by the row's id.
    nodes = stash(real.groupBy("mark").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"), F.any_value("bands").alias("bands")))
    no_id = not nodes.filter("least IS NULL").isEmpty()  # only where all rows of a set lack an id

    def texts_of(wanted: DataFrame) -> DataFrame:
        """The texts of the wanted nodes (least); other texts of rows without an id, or with a repeated one, may come along."""
        few = at_most(wanted, BROADCAST_ROWS)
        ids = wanted.select(F.col("least").alias("doc_id"))
        texts = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("text")
        return texts.unionByName(docs.filter("doc_id IS NULL").select("text")) if no_id else texts

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(mark, shingles) of the wanted marks, from the text of one row each."""
        ids = stash(join_counted(nodes.select("mark", "least"), wanted, "mark", "left_semi"))
        kind = pa.schema([("mark", pa.int64()), ("shingles", pa.binary())])

        def full(cols: dict) -> dict:
            sets = shingles(texts_as_bytes(cols["text"]))
            return {"mark": [fingerprint(s) if len(s) else None for s in sets], "shingles": packed(sets)}

        got = texts_of(ids).mapInArrow(each_batch(full, kind), "mark long, shingles binary")
        return got.join(ids.select("mark"), "mark", "left_semi").dropDuplicates(["mark"])

    def confirmed(stars: DataFrame) -> DataFrame:
        """Links (a, b) among the pairs stars (mark, hub)."""
        sets = stash(sets_of(stars.select("mark").unionByName(stars.select(F.col("hub").alias("mark"))).distinct()))
        load = stars.groupBy("hub").agg(F.count("*").alias("members")).withColumn("salts", F.ceil(F.col("members") / QUERIES))
        salted = stars.join(load, "hub").select("mark", F.xxhash64("hub", F.pmod(F.xxhash64("mark"), "salts")).alias("block"))
        blocks = load.select(F.col("hub").alias("mark"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        blocks = blocks.select("mark", F.xxhash64("mark", "salt").alias("block")).join(sets, "mark").withColumn("part", F.col("mark"))
        found = stash(search(blocks, salted.join(sets, "mark").withColumn("part", F.col("mark"))))
        discard(sets)
        return found

    def parts_by(links: DataFrame) -> DataFrame:
        return stash(components(links).select(F.col("id").alias("mark"), F.col("component").alias("part")))

    def as_links(parts: DataFrame) -> DataFrame:
        return parts.select(F.col("mark").alias("a"), F.col("part").alias("b"))

    def with_part(df: DataFrame, parts: DataFrame) -> DataFrame:
        return join_counted(df, parts, "mark", "left").withColumn("part", F.coalesce("part", "mark"))

    # 1. Stars of equal band keys, confirmed.
    keys = nodes.select("mark", F.posexplode("bands").alias("band", "key"))
    hubs = keys.groupBy("band", "key").agg(F.min("mark").alias("hub"), F.count("*").alias("size")).filter("size > 1")
    stars = stash(keys.join(hubs, ["band", "key"]).filter("mark != hub").select("mark", "hub").distinct())
    parts = parts_by(confirmed(stars))

    # 2. The order of the shingles, then the shortest lists of every set.
    release(spark)
    alone = nodes.select("mark", "least").join(parts.filter("mark != part"), "mark", "left_anti")  # one set of each part
    late = spark.sparkContext.broadcast(frequent_levels(texts_of(alone), most_levels))
    low_kind = pa.schema([("mark", pa.int64()), ("n", pa.int64()), ("low", pa.binary()), ("bits", pa.binary())])

    def lowest(cols: dict) -> dict:
        sets = [s for s in shingles(texts_as_bytes(cols["text"])) if len(s)]
        lows = [ranked(s, late.value)[: max(dealt(len(s)), math.ceil(WINDOW * len(s)) + 2)] for s in sets]
        return {"mark": [fingerprint(s) for s in sets], "n": [len(s) for s in sets], "low": packed(lows), "bits": pa.array([parity(s) for s in sets], pa.binary())}

    lows = stash(texts_of(nodes).mapInArrow(each_batch(lowest, low_kind), "mark long, n long, low binary, bits binary"))
    total = nodes.agg(F.sum(F.col("n") * (1 - PERCENT / 100) + 1)).first()[0] or 0
    found = stash(short_lists(with_part(lows, parts).select("part", "n", "low"), max(16, int(total / 4e5) + 1), longest))
    cand, entries = found.filter("token IS NULL").select("a", "b"), found.filter("token IS NOT NULL").select("token", F.col("a").alias("part"), F.col("b").alias("left"))

    # 3. Long lists: stars first, then the pairs of the parts that are still apart.
    if not entries.isEmpty():
        hosts = entries.groupBy("token").agg(F.max(F.struct("left", F.col("part").alias("hub"))).alias("host"))
        reach = (F.lit(7 / 3) * (0.75 + 0.25 * F.col("left") / int(LOW)) - 1) * (F.lit(7 / 3) * (0.75 + 0.25 * F.col("host.left") / int(LOW)) - 1)
        stars = entries.join(hosts, "token").filter((F.col("part") != F.col("host.hub")) & (reach >= 1 - 1e-6)).select(F.col("part").alias("mark"), F.col("host.hub").alias("hub")).distinct()
        moved = parts_by(as_links(parts).unionByName(confirmed(stash(stars))))
        anew = join_counted(entries, moved.withColumnRenamed("mark", "old").withColumnRenamed("part", "new").withColumnRenamed("old", "part"), "part", "left")
        anew = anew.groupBy("token", F.coalesce("new", "part").alias("part")).agg(F.max("left").alias("left"))
        asked = anew.select(F.col("part").alias("mark")).distinct().join(moved, "mark", "left_anti")  # parts of one set
        told = join_counted(lows.select("mark", "n", "bits"), stash(asked), "mark", "left_semi").dropDuplicates(["mark"])
        anew = anew.join(told.withColumnRenamed("mark", "part"), "part", "left")
        for side in ("a", "b"):
            cand = join_counted(cand, moved.select(F.col("mark").alias(side), F.col("part").alias("new")), side, "left").withColumn(side, F.coalesce("new", side)).drop("new")
        cand = cand.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").unionByName(long_list_pairs(stash(anew)))
        parts = moved
    release(spark)

    # 4. The search in candidate parts.
    stats = with_part(nodes.select("mark", "n"), parts).groupBy("part").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("members"))
    cand = cand.distinct()
    for side in ("a", "b"):
        cand = cand.join(stats.select(F.col("part").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("lo", "hi", "members")]), side)
    fits = (F.col("a_hi") * 100 >= PERCENT * F.col("b_lo")) & (F.col("b_hi") * 100 >= PERCENT * F.col("a_lo"))
    larger = (F.col("a_members") > F.col("b_members")) | ((F.col("a_members") == F.col("b_members")) & (F.col("a") < F.col("b")))
    sides = {"host": ("a", "b"), "guest": ("b", "a"), "members": ("a_members", "b_members"), "guests": ("b_members", "a_members")}
    cand = stash(cand.filter(fits).select(*[F.when(larger, F.col(x)).otherwise(F.col(y)).alias(name) for name, (x, y) in sides.items()]))
    # Of two single sets the lowest shingles bound the overlap, which settles nearly all pairs that only share a passage.
    single = (F.col("members") == 1) & (F.col("guests") == 1)
    ones, profile_of = cand.filter(single), lows.dropDuplicates(["mark"])
    wanted = ones.select(F.col("host").alias("mark")).unionByName(ones.select(F.col("guest").alias("mark"))).distinct()
    profile_of = stash(join_counted(profile_of, wanted, "mark", "left_semi"))
    for side in ("host", "guest"):
        ones = ones.join(profile_of.select(F.col("mark").alias(side), F.col("n").alias(f"{side}_n"), F.col("low").alias(f"{side}_low")), side)

    def possible(batches):
        for batch in batches:
            c = {x: batch.column(x).to_pylist() for x in batch.schema.names}
            keep = [may_reach(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), n, m) for x, y, n, m in zip(c["host_low"], c["guest_low"], c["host_n"], c["guest_n"])]
            yield batch.select(["host", "guest", "members", "guests"]).filter(pa.array(keep, pa.bool_()))

    ones = ones.mapInArrow(possible, "host long, guest long, members long, guests long")
    cand = stash(cand.filter(~single).unionByName(ones))
    discard(lows, profile_of, found)
    release(spark)
    needed = cand.select(F.col("host").alias("part")).unionByName(cand.select(F.col("guest").alias("part"))).distinct()
    members = stash(with_part(nodes.select("mark"), parts).join(needed, "part", "left_semi"))
    sets = stash(members.join(sets_of(members.select("mark")), "mark"))
    load = cand.groupBy("host", "members").agg(F.sum("guests").alias("asking"))
    load = load.withColumn("salts", F.ceil(F.col("asking") / QUERIES)).withColumn("chunks", F.ceil(F.col("members") / BLOCK))
    spread = load.select("host", "chunks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    index = sets.join(spread, sets["part"] == spread["host"]).select("mark", "part", "shingles", F.xxhash64("host", F.pmod(F.xxhash64("mark"), "chunks"), "salt").alias("block"))
    asks = cand.select("host", "guest").join(load.select("host", "salts", "chunks"), "host")
    asked = sets.join(asks, sets["part"] == asks["guest"]).withColumn("salt", F.pmod(F.xxhash64("mark"), "salts"))
    asked = asked.select("mark", "part", "shingles", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda c: F.xxhash64("host", c, "salt"))).alias("block"))
    links = as_links(parts).unionByName(stash(search(index, asked)))
    discard(sets, members, cand)

    whole = components(links).select(F.col("id").alias("mark"), "component")
    classes = nodes.select("mark", "least").join(whole, "mark", "left").withColumn("class", F.coalesce("component", "mark"))
    least = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "class").select("mark", "component_id")
    empty = known.filter("mark IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return join_counted(real.select("doc_id", "n_shingles", "mark"), named, "mark").select("doc_id", "n_shingles", "component_id").unionByName(empty)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
