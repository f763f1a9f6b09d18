"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

Equal vectors are one node. A node is rotated by random signs and fast Hadamard transforms (three rounds each) and hashed
to the nearest signed axis; `functions` such hashes make the key of a table. Beside its own key a node probes, for
each function, the second nearest axis. First all nodes of a bucket are compared with the bucket's smallest one; confirmed links make parts.
Then all pairs of different parts in a bucket, of which at least one has the key as its own, are candidates if their
128-bit sign sketches are near; buckets too large for a task are split into pairs of chunks. Candidates are verified in double precision. Last, every
component counts its links exactly by blocks, so a dense group is never written out as pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers link with nothing; vectors of different length never
link; repeated rows and equal vectors link with each other; other columns are ignored; an empty table gives an
empty result; rows without an id take part, and a component's id is the smallest that is not null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import each_batch, join_counted, list_array, mix, stash, table
from foliant.llm.components import components

TABLES, SKETCH_LIMIT, CHUNK, BLOCK = 10, 40, 20_000, 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def polytope(x: np.ndarray, functions: int) -> tuple[np.ndarray, np.ndarray]:
    """Own keys (n, TABLES) and probed keys (n, TABLES * functions) of unit vectors."""
    n, dim = x.shape
    width = 1 << max(1, (dim - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - dim)))
    own, probes, rows = [], [], np.arange(n)
    with np.errstate(over="ignore"):
        for t in range(TABLES):
            first, second = [], []
            for f in range(functions):
                y = rotate(x, 1000 * t + f)
                size = np.abs(y)
                for out in (first, second):
                    at = size.argmax(axis=1)
                    out.append((2 * at + (y[rows, at] < 0)).astype(np.uint64))
                    size[rows, at] = -1

            def key(axes: list[np.ndarray]) -> np.ndarray:
                k = np.full(n, (dim << 8) + t, np.uint64)
                for a in axes:
                    k = mix(k * np.uint64(1 << 20) + a + np.uint64(1))
                return k.view(np.int64)

            own.append(key(first))
            for f in range(functions):
                probes.append(key([second[g] if g == f else first[g] for g in range(functions)]))
    return np.stack(own, axis=1), np.stack(probes, axis=1)


def sketches(x: np.ndarray) -> np.ndarray:
    """128 signs of random projections, as two numbers."""
    planes = np.random.default_rng(77).normal(size=(x.shape[1], 128))
    return np.packbits(x @ planes > 0, axis=1).view(np.int64).reshape(len(x), 2)


def matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def near(bits_a: np.ndarray, bits_b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits_a ^ bits_b).sum(axis=-1) <= SKETCH_LIMIT


def bucket_pairs(key: np.ndarray, mark: np.ndarray, part: np.ndarray, own: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Pairs of marks of different parts in one bucket with near sketches; one of the two owns the key."""
    order = np.lexsort((part, key))
    key, mark, part, own, bits = key[order], mark[order], part[order], own[order], bits[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    end = np.concatenate((at[1:], [len(key)])).astype(np.int64)
    many = part[at] != part[end - 1]  # sorted by part: more than one
    out = [np.zeros((0, 2), np.int64)]
    size = end - at
    for n in np.unique(size[many & (size <= 64)]):
        rows = at[many & (size == n)][:, None] + np.arange(n)
        for gap in range(1, int(n)):
            i, j = rows[:, :-gap].ravel(), rows[:, gap:].ravel()
            ok = (part[i] != part[j]) & (own[i] | own[j])
            i, j = i[ok], j[ok]
            ok = near(bits[i], bits[j])
            out.append(np.stack((mark[i[ok]], mark[j[ok]]), axis=1))
    for a, e in zip(at[many & (size > 64)], end[many & (size > 64)]):
        for i in range(a, e, BLOCK):
            ie = min(i + BLOCK, e)
            for j in range(i, e, BLOCK):
                je = min(j + BLOCK, e)
                if part[i] == part[je - 1]:  # all of one part
                    continue
                ok = (part[i:ie, None] != part[None, j:je]) & (own[i:ie, None] | own[None, j:je]) & near(bits[i:ie, None], bits[None, j:je])
                x, y = np.nonzero(ok)
                out.append(np.stack((mark[i + x], mark[j + y]), axis=1))
    pairs = np.concatenate(out)
    return np.unique(np.sort(pairs, axis=1), axis=0)


def embedding_components(vectors: DataFrame, *, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("mark", F.when(F.coalesce(fine, F.lit(False)), F.xxhash64("v")))
    known = stash(rows)
    real = known.filter("mark IS NOT NULL")
    nodes = stash(real.groupBy("mark").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.any_value("v").alias("v")))
    n, dim = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
    functions = min(4, max(1, round(math.log(max(n, 2)) / math.log(2 * max(dim or 2, 2)))))
    kind = pa.schema([("mark", pa.int64()), ("own", pa.list_(pa.int64())), ("probes", pa.list_(pa.int64())), ("s1", pa.int64()), ("s2", pa.int64())])

    def hashes(cols: dict) -> dict:
        lists = cols["v"]
        sizes = np.diff(lists.offsets.to_numpy())
        count = len(sizes)
        own, probes, bits = np.zeros((count, TABLES), np.int64), np.zeros((count, TABLES * functions), np.int64), np.zeros((count, 2), np.int64)
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            x = matrix(lists.take(pa.array(at)), len(at))
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            own[at], probes[at] = polytope(x, functions)
            bits[at] = sketches(x)
        return {"mark": cols["mark"], "own": list_array(own.ravel(), np.full(count, TABLES), pa.int64()), "probes": list_array(probes.ravel(), np.full(count, TABLES * functions), pa.int64()), "s1": bits[:, 0], "s2": bits[:, 1]}

    hashed = stash(nodes.select("mark", "v").mapInArrow(each_batch(hashes, kind, 4000), "mark long, own array<long>, probes array<long>, s1 long, s2 long"))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose cosine is at least `least`."""
        full = pairs.join(nodes.select(F.col("mark").alias("a"), F.col("v").alias("va")), "a").join(nodes.select(F.col("mark").alias("b"), F.col("v").alias("vb")), "b").filter(F.size("va") == F.size("vb"))

        def check(batches):
            for batch in batches:
                x, y = batch.column(2), batch.column(3)
                sizes, keep = np.diff(x.offsets.to_numpy()), np.zeros(batch.num_rows, bool)
                for d in np.unique(sizes):
                    at = np.flatnonzero(sizes == d)
                    p, q = matrix(x.take(pa.array(at)), len(at)), matrix(y.take(pa.array(at)), len(at))
                    keep[at] = cosines(p, q) >= least
                yield batch.select([0, 1]).filter(pa.array(keep))

        return full.select("a", "b", "va", "vb").mapInArrow(check, "a long, b long")

    # Stars: every node against the smallest of its bucket.
    keys = hashed.select("mark", "s1", "s2", F.explode("own").alias("key"))
    hubs = keys.groupBy("key").agg(F.min(F.struct("mark", "s1", "s2")).alias("hub"), F.count("*").alias("size")).filter("size > 1")
    close = F.bit_count(F.col("s1").bitwiseXOR(F.col("hub.s1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("hub.s2"))) <= SKETCH_LIMIT
    stars = keys.join(hubs, "key").filter((F.col("mark") != F.col("hub.mark")) & close).select(F.col("mark").alias("a"), F.col("hub.mark").alias("b")).distinct()
    links = stash(verified(stars))
    parts = stash(components(links).select(F.col("id").alias("mark"), F.col("component").alias("part")))

    # Candidates between parts.
    own, probed = (hashed.select("mark", "s1", "s2", F.explode(c).alias("key"), F.lit(c == "own").alias("own")) for c in ("own", "probes"))
    entries = join_counted(own.unionByName(probed), parts, "mark", "left").withColumn("part", F.coalesce("part", "mark"))
    load = entries.groupBy("key").agg(F.count("*").alias("size"), F.min("part").alias("p"), F.max("part").alias("q")).filter("p != q").select("key", F.ceil(F.col("size") / CHUNK).alias("chunks"))
    dealt = entries.join(load, "key").withColumn("chunk", F.pmod(F.xxhash64("mark"), "chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    dealt = dealt.withColumn("other", other).select(F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("key"), "mark", "part", "own", "s1", "s2").repartition("key")

    def meet(batches):
        got = pa.Table.from_batches(list(batches))
        if got.num_rows:
            c = {x: got.column(x).to_numpy() for x in ("key", "mark", "part", "own", "s1", "s2")}
            pairs = bucket_pairs(c["key"], c["mark"], c["part"], c["own"].astype(bool), np.stack((c["s1"], c["s2"]), axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def meet_all(batches):
        batches = [b for b in batches if b.num_rows]
        yield from meet(batches) if batches else ()

    links = links.unionByName(stash(verified(dealt.mapInArrow(meet_all, "a long, b long").distinct())))
    whole = stash(components(links).select(F.col("id").alias("mark"), "component"))

    # Exact link counts inside components, by pairs of blocks; small components share a block.
    sizes = whole.groupBy("component").agg(F.count("*").alias("members"))
    packs = max(1, -(-whole.count() // 500))
    members = whole.join(sizes, "component").join(nodes.select("mark", "copies", "v"), "mark").withColumn("blocks", F.ceil(F.col("members") / BLOCK))
    small = F.col("blocks") == 1
    members = members.withColumn("block", F.pmod(F.xxhash64("mark", F.lit(5)), "blocks"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    grp = F.when(small, F.pmod(F.xxhash64("component"), F.lit(packs))).otherwise(F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")))
    members = members.select(grp.alias("grp"), (F.col("block") <= F.col("other")).alias("left"), (F.col("block") >= F.col("other")).alias("right"), "component", "mark", "copies", "v")

    def count(got: pa.Table) -> pa.Table:
        sizes = got.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        left, right = (got.column(c).to_numpy().astype(bool) for c in ("left", "right"))
        component, mark, copies = (got.column(c).to_numpy() for c in ("component", "mark", "copies"))
        total = np.zeros(got.num_rows, np.int64)
        for d in np.unique(sizes):
            a, b = np.flatnonzero(left & (sizes == d)), np.flatnonzero(right & (sizes == d))
            v = got.column("v").combine_chunks()
            x, y = matrix(v.take(pa.array(a)), len(a)), matrix(v.take(pa.array(b)), len(b))
            nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
            for i in range(0, len(a), BLOCK):
                s = slice(i, i + BLOCK)
                linked = (x[s] @ y.T / (nx[s, None] * ny) >= least) & (component[a[s], None] == component[b]) & (mark[a[s], None] != mark[b])
                total[a[s]] += linked @ copies[b]
                once = linked & ~(left[b] & right[a[s], None])  # the other direction is met in this block only here
                total[b] += copies[a[s]] @ once
        kept = total > 0
        return pa.Table.from_arrays([pa.array(mark[kept]), pa.array(total[kept])], schema=pa.schema([("mark", pa.int64()), ("links", pa.int64())]))

    counts = members.groupBy("grp").applyInArrow(count, "mark long, links long").groupBy("mark").agg(F.sum("links").alias("links"))
    named = nodes.select("mark", "first_id", "copies").join(whole, "mark", "left").join(counts, "mark", "left").withColumn("component", F.coalesce("component", "mark"))
    named = named.join(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "component")
    found = real.join(named, "mark").select("vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), "component_id")
    alone = known.filter("mark IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def cosines(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", p, q) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))
