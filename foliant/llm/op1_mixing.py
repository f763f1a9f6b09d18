"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over exact block quotas.

Targets: the sources share the total size by weight, none above `most` times its own size; what a source cannot take
is shared again among the others. A source's documents fall into blocks by a hash, and its target is a quota of block draws: whole
passes over all blocks, then a part of one pass whose last block is cut at a document, and that document at a word, so the target is met
exactly. The quotas of all sources are split down a binary tree among the output shards: a node gives its left half a
multivariate-hypergeometric share, drawn source by source. A shard then takes its run of each source's permuted draws,
disjoint from all other shards, and orders its documents by a hash.

Everything is DataFrame functions. Windows run over sources and over blocks, never over documents, but for the documents of a source's one
cut block. Draws follow hashes of the seed, so reruns agree.

Defined cases: a null text has size 0; the null source is a source of its own and comes last; documents of size 0 take 0 words;
repeated rows are mixed one by one, also those equal in id and text; ties in the order of documents go by id and size; texts of any length
are counted and drawn whole; other columns, whatever their names, are ignored by the query and kept by the mix; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import BROADCAST_ROWS, WORD, at_most, stash, table, unused

#: Words of a block, at most this many blocks of a source.
BLOCK_WORDS, MOST_BLOCKS = 1 << 15, 1024
#: Words of a shard, about, where the number of shards is not given.
SHARD_WORDS = 1 << 22


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[int], most: int) -> DataFrame:
    """sizes (source, source_size) with the number of each source in code-point order, null last, its weight and target.

    With sources in the order of what they can take for their weight, those are full for which a level set by the rest is too
    high; the rest share what is left by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("number", F.row_number().over(order) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("double"))
    rows = rows.withColumn("cap", F.col("source_size").cast("double") * most)
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    rows = rows.withColumn("taken_before", F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("weight_left", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
    level = (F.col("total") - F.col("taken_before")) / F.col("weight_left")
    rows = rows.withColumn("full", F.col("cap") / F.col("weight") <= level)
    first = F.max(F.when(F.col("full"), F.struct("taken_before", "cap"))).over(Window.partitionBy())
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(Window.partitionBy())
    taken = F.coalesce(first["taken_before"] + first["cap"], F.lit(0.0))
    level = (F.col("total") - taken) / open_weight
    rows = rows.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight"))))
    return rows.select("source", "source_size", "number", "target")


def uniform(*key: Column | str) -> Column:
    """A number in [0, 1) that follows from the key."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 52)).cast("double") / float(1 << 52)


def hypergeometric(total: Column, marked: Column, drawn: Column, *key: Column) -> Column:
    """How many of `drawn` draws without return from `total` hit one of `marked`; the draws are made one by one."""
    draws = F.when(drawn > 0, F.sequence(F.lit(1).cast("long"), drawn)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(draws, F.lit(0).cast("long"), lambda hits, i: hits + F.when(uniform(*key, i) * (total - i + 1) < (marked - hits), 1).otherwise(0))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, number, quota) from (number, quota): the tree, a level at a time; a node's row has all sources' quotas."""
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("number", "quota"))).alias("q")).select(F.lit(0).alias("low"), F.lit(shards).alias("high"), "q")
    width = 1
    while width < shards:
        width *= 2
    while width > 1:
        half = width // 2
        total = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x["quota"])
        capacity = (total * half / width).cast("long")
        start = F.struct(total.alias("total"), capacity.alias("capacity"), F.array().cast("array<struct<number:int,quota:bigint>>").alias("left"))

        def step(state: Column, x: Column) -> Column:
            hit = hypergeometric(state["total"], x["quota"], state["capacity"], F.lit(seed), F.col("low"), F.lit(half), x["number"])
            return F.struct((state["total"] - x["quota"]).alias("total"), (state["capacity"] - hit).alias("capacity"), F.concat(state["left"], F.array(F.struct(x["number"].alias("number"), hit.alias("quota")))).alias("left"))

        nodes = nodes.withColumn("left", F.aggregate("q", start, step, lambda s: s["left"]))
        nodes = nodes.withColumn("right", F.zip_with("q", "left", lambda a, b: F.struct(a["number"].alias("number"), (a["quota"] - b["quota"]).alias("quota"))))
        halves = F.array(F.struct(F.col("low"), F.col("left").alias("q")), F.struct((F.col("low") + half).alias("low"), F.col("right").alias("q")))
        nodes = nodes.select(F.explode(halves).alias("h")).select("h.low", F.lit(0).alias("high"), "h.q")
        width = half
    return nodes.select(F.col("low").alias("shard"), F.explode("q").alias("x")).select("shard", "x.number", "x.quota")


def plan(sized: DataFrame, weights: list[int], most: int, shards: int | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """sized with source_size, target, taken and draws (pass, shard, words); and the plan of the sources."""
    sized = sized.withColumn("block_of", F.xxhash64("doc_id", F.lit(seed)))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    sources = sources.withColumn("blocks", F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("source_size") / BLOCK_WORDS) + 1).cast("long"))
    quota = F.round("target").cast("long")
    sources = sources.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("long")).withColumn("rest", quota - F.col("passes") * F.col("source_size"))
    sources = stash(sources.withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))))

    if shards is None:
        drawn = sources.agg(F.sum("target")).first()[0] or 0.0
        shards = 1 << max(6, int(drawn / SHARD_WORDS).bit_length())
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    docs = sized.withColumn("source_key", key).drop("source").join(F.broadcast(sources) if at_most(sources, 4096) else sources, "source_key")
    docs = docs.withColumn("block", F.pmod("block_of", "blocks"))
    blocks = docs.groupBy("number", "block").agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))

    # The last pass takes blocks in the order of a hash until its share is full; the block at the edge is cut.
    order = Window.partitionBy("number").orderBy(F.xxhash64(F.lit(seed), "number", F.col("passes"), "block"), "block")
    blocks = blocks.withColumn("before", F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = blocks.withColumn("in_rest", F.col("before") < F.col("rest")).withColumn("cut", F.when(F.col("before") + F.col("words") > F.col("rest"), F.col("rest") - F.col("before")))
    blocks = stash(blocks)

    # Draws: a row for each block and pass, its place in the source's permutation, and with it its shard.
    times = F.col("passes") + F.col("in_rest").cast("long")
    draws = blocks.filter(times > 0).select("number", "block", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)).alias("pass"))
    place = F.row_number().over(Window.partitionBy("number").orderBy("pass", F.xxhash64(F.lit(seed + 1), "number", "pass", "block"), "block"))
    draws = draws.withColumn("place", place.cast("long"))
    shares = split_quotas(draws.groupBy("number").agg(F.count("*").alias("quota")), shards, seed)
    upto = F.sum("quota").over(Window.partitionBy("number").orderBy("shard"))
    shares = shares.withColumn("end", upto).withColumn("begin", F.col("end") - F.col("quota")).filter("quota > 0")
    ranges = shares.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "shard"))).alias("ranges"))
    draws = draws.join(ranges, "number").withColumn("shard", F.filter("ranges", lambda r: (r["begin"] < F.col("place")) & (F.col("place") <= r["end"]))[0]["shard"])
    drawn = draws.groupBy("number", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("draws"))
    by_block = stash(blocks.join(drawn, ["number", "block"], "left").select("number", "block", "in_rest", "cut", "draws"))

    docs = docs.drop("blocks").join(F.broadcast(by_block) if at_most(by_block, 65536) else by_block, ["number", "block"])
    edge = docs.filter("in_rest AND cut IS NOT NULL")
    inside = Window.partitionBy("number").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id"), "doc_id", "size", "order_key").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("rest_words", F.greatest(F.lit(0), F.least("size", F.col("cut") - F.coalesce(F.sum("size").over(inside), F.lit(0)))))
    whole = docs.filter("NOT (in_rest AND cut IS NOT NULL)").withColumn("rest_words", F.when(F.col("in_rest"), F.col("size")).otherwise(0))
    docs = whole.unionByName(edge).withColumn("taken", F.col("passes") * F.col("size") + F.col("rest_words"))
    each = F.transform(F.coalesce("draws", F.array().cast("array<struct<pass:bigint,shard:int>>")), lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.when(d["pass"] < F.col("passes"), F.col("size")).otherwise(F.col("rest_words")).alias("words")))
    return docs.withColumn("draws", F.filter(each, lambda d: d["words"] > 0)), sources


def mix_plan(docs: DataFrame, *, weights: list[int] = (1, 2, 3), most: int = 3, shards: int | None = None, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken and draws (pass, shard, words) of every row of docs (doc_id, text, source)."""
    sized = stash(docs.select(F.col("doc_id").cast("long"), "source", word_count("text").alias("size"), F.xxhash64("text").alias("order_key")))
    planned, _ = plan(sized, list(weights), most, shards, seed)
    return planned.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long"), "draws")


def mix(docs: DataFrame, *, weights: list[int] = (1, 2, 3), most: int = 3, shards: int | None = None, seed: int = 17) -> DataFrame:
    """The mix itself: the rows of docs (doc_id, text, source, ...) as often as they are drawn, by shard, shuffled in it.

    The one document at a source's edge comes whole if at least half of it is drawn, and not at all otherwise.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    id_, none, key, row, size = (unused(docs.columns, name) for name in ("_id", "_no_id", "_key", "_row", "_words"))
    rows = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), none: F.col("doc_id").isNull(), key: F.xxhash64("text"), row: F.lit(0).cast("long"), size: word_count("text")})
    names = [id_, none, key]
    repeats = stash(rows.groupBy(*names).agg(F.count("*").alias(unused(docs.columns, "_n"))).filter(F.col(unused(docs.columns, "_n")) > 1).select(*names))
    if repeats.stashed_rows:  # rows equal in id and text are written down, so that each has a number of its own
        few = F.broadcast(repeats) if at_most(repeats, BROADCAST_ROWS) else repeats
        equal = stash(rows.join(few, names, "left_semi").withColumn(row, F.monotonically_increasing_id() + 1))
        rows = rows.join(few, names, "left_anti").unionByName(equal)
    names.append(row)
    slim = stash(rows.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("doc_id"), "source", F.col(size).alias("size"), F.lit(0).alias("order_key")))
    planned, _ = plan(slim, list(weights), most, shards, seed)
    draw, draws, shard, at = (unused(docs.columns, name) for name in ("_draw", "_draws", "_shard", "_at"))
    planned = planned.select(*[F.col(f"doc_id.c{i}").alias(c) for i, c in enumerate(names)], F.col("draws").alias(draws)).filter(F.size(draws) > 0)
    drawn = rows.join(planned, names).withColumn(draw, F.explode(draws)).filter(2 * F.col(draw)["words"] >= F.col(size))
    drawn = drawn.withColumn(at, F.xxhash64(F.lit(seed + 3), *names, F.col(draw)["pass"])).withColumn(shard, F.col(draw)["shard"])
    return drawn.repartition(shard).sortWithinPartitions(shard, at).select(*columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"))
